"""Reading executed plans in tests."""


def final_plan(frame) -> list[str]:
    """Lines of the plan as it ran, without the superseded initial plans."""
    frame.collect()
    kept, skip_below = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip_below is not None and depth >= skip_below:
            continue
        skip_below = depth if "== Initial Plan ==" in line else None
        if skip_below is None:
            kept.append(line)
    return kept


def nodes(lines: list[str], name: str) -> list[str]:
    """Lines whose operator is ``name``; mentions inside another operator do not count."""
    found = []
    for line in lines:
        operator = line.lstrip(" :+-").lstrip("*(0123456789) ")
        if operator.startswith(name):
            found.append(line)
    return found
