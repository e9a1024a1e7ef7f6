"""Reading monthly files."""

from datetime import datetime

import pytest

from flightpulse.sources.monthly_csv import (
    list_monthly_files,
    month_of_file,
    read_header,
    read_monthly_directory,
)
from flightpulse.sources.tables import read_flights, write_flights
from flightpulse.vocabulary import SOURCE_COLUMNS

PREAMBLE = "Atualizado em: 2025-01-01"
HEADER = [
    "ICAO Empresa Aérea",
    "ICAO Aeródromo Origem",
    "ICAO Aeródromo Destino",
    "Partida Prevista",
    "Partida Real",
    "Chegada Prevista",
    "Chegada Real",
    "Situação Voo",
    "Código Justificativa",
]
ROW = {
    "ICAO Empresa Aérea": "GLO",
    "ICAO Aeródromo Origem": "SBSP",
    "ICAO Aeródromo Destino": "SBRJ",
    "Partida Prevista": "2024-01-05 10:00:00",
    "Partida Real": "2024-01-05 10:40:00",
    "Chegada Prevista": "2024-01-05 11:00:00",
    "Chegada Real": "2024-01-05 11:35:00",
    "Situação Voo": "REALIZADO",
    "Código Justificativa": "",
}


def write_file(folder, name, rows, header=HEADER, newline="\n"):
    lines = [PREAMBLE, ";".join(header)]
    lines += [";".join({**ROW, **row}.get(column, "") for column in header) for row in rows]
    text = newline.join(lines) + newline
    (folder / name).write_bytes(text.encode("utf-8-sig"))


def test_month_from_name():
    assert month_of_file("/x/VRA_20241.csv") == "2024-01"
    assert month_of_file("/x/VRA_202411.csv") == "2024-11"
    assert month_of_file("VRA_202501.csv") == "2025-01"
    with pytest.raises(ValueError):
        month_of_file("VRA_2024.csv")
    with pytest.raises(ValueError):
        month_of_file("VRA_20241.csv.bak")


def test_listing_is_sorted_by_month(spark, tmp_path):
    for name in ("VRA_202411.csv", "VRA_20242.csv", "VRA_20241.csv", "other.csv"):
        write_file(tmp_path, name, [{}])
    names = [path.rsplit("/", 1)[1] for path in list_monthly_files(spark, str(tmp_path))]
    assert names == ["VRA_20241.csv", "VRA_20242.csv", "VRA_202411.csv"]


def test_empty_directory(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        list_monthly_files(spark, str(tmp_path))


def test_headers_in_any_order_and_extra_columns(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{}, {"ICAO Empresa Aérea": "TAM"}])
    other = ["Número Voo", *reversed(HEADER)]
    write_file(tmp_path, "VRA_202411.csv", [{"Número Voo": "1234", "ICAO Empresa Aérea": "AZU"}], other)
    rows = read_monthly_directory(spark, str(tmp_path)).collect()
    found = {row.carrier: row for row in rows}
    assert len(rows) == 3 and set(found) == {"GLO", "TAM", "AZU"}
    assert found["GLO"].ref_month == "2024-01" and found["AZU"].ref_month == "2024-11"
    assert found["AZU"]["Número Voo"] == "1234" and found["TAM"]["Número Voo"] is None
    assert found["AZU"].actual_dep == datetime(2024, 1, 5, 10, 40)
    assert "Código Justificativa" not in rows[0].asDict()


def test_awkward_names_and_tokens(spark, tmp_path):
    odd = ["Nº. d'eq\\uip`", *HEADER]
    write_file(tmp_path, "VRA_20241.csv", [{odd[0]: "x"}, {odd[0]: "it's"}, {odd[0]: "a\\b"}], odd)
    rows = read_monthly_directory(spark, str(tmp_path), na_tokens=("", "it's", "a\\b")).collect()
    assert sorted(str(row[odd[0]]) for row in rows) == ["None", "None", "x"]


def test_missing_tokens_quotes_and_line_ends(spark, tmp_path):
    rows = [
        {"ICAO Empresa Aérea": "NA"},
        {"ICAO Empresa Aérea": "null"},
        {"ICAO Empresa Aérea": '""'},
        {"ICAO Empresa Aérea": ""},
        {"ICAO Empresa Aérea": '"A;B"'},
        {"ICAO Empresa Aérea": '"say ""x"""'},
        {"ICAO Empresa Aérea": " NA"},
    ]
    write_file(tmp_path, "VRA_20243.csv", rows, newline="\r\n")
    found = read_monthly_directory(spark, str(tmp_path)).collect()
    texts = sorted(row.carrier for row in found if row.carrier is not None)
    assert texts == [" NA", "A;B", 'say "x"']
    assert sum(row.carrier is None for row in found) == 4
    assert {row.status for row in found} == {"REALIZADO"}
    kept = read_monthly_directory(spark, str(tmp_path), na_tokens=("",)).collect()
    assert {"NA", "null"} <= {row.carrier for row in kept}
    assert {"NA", "null"} <= {
        row.carrier for row in read_monthly_directory(spark, str(tmp_path), na_tokens=()).collect()
    }


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-31 23:59:59", datetime(2024, 1, 31, 23, 59, 59)),
        ("2024-1-1 1:00:00", datetime(2024, 1, 1, 1)),
        ("2024-02-30 01:00:00", None),
        ("2024-01-01 24:00:00", None),
        ("2024-01-01 10:00", None),
        ("2024-01-01T10:00:00", None),
        ("2024-01-01 10:00:00.5", None),
        (" 2024-01-01 10:00:00", None),
        ("01/02/2024 10:00:00", None),
        ("x", None),
        ("", None),
    ],
)
def test_timestamps(spark, tmp_path, text, expected):
    write_file(tmp_path, "VRA_20241.csv", [{"Partida Prevista": text}])
    row = read_monthly_directory(spark, str(tmp_path)).first()
    assert row.sched_dep == expected
    assert row.actual_dep == datetime(2024, 1, 5, 10, 40)


def test_header_after_blank_line_and_repeated_names(spark, tmp_path):
    path = tmp_path / "VRA_20241.csv"
    path.write_text(f"{PREAMBLE}\n\na;b;a;;a\n", encoding="utf-8-sig")
    assert read_header(spark, str(path)) == ("a", "b", "a.1", "Unnamed: 3", "a.2")


def test_missing_column_is_an_error(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{}], HEADER[:-1])
    with pytest.raises(ValueError, match="Código Justificativa"):
        read_monthly_directory(spark, str(tmp_path))


@pytest.mark.parametrize("multi_line", [False, True])
@pytest.mark.parametrize("last", ["x;y", "x;", "x;;y", ";;;", '"x;1";', '"a""b";""'])
def test_row_longer_than_header_is_an_error(spark, tmp_path, last, multi_line):
    write_file(tmp_path, "VRA_20241.csv", [{"Código Justificativa": last}])
    for select in ("*", "carrier"):
        with pytest.raises(Exception, match="more fields than its header"):
            read_monthly_directory(spark, str(tmp_path), multi_line=multi_line).select(select).collect()


def test_quoted_separators_are_no_further_fields(spark, tmp_path):
    rows = [{"Situação Voo": '"a;b"', "Código Justificativa": '"x;y""z;"'}, {"Situação Voo": '5" x'}]
    write_file(tmp_path, "VRA_20241.csv", rows)
    assert sorted(row.status for row in read_monthly_directory(spark, str(tmp_path)).collect()) == ['5" x', "a;b"]


def test_header_after_any_number_of_blank_lines(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{}, {}])
    path = tmp_path / "VRA_20241.csv"
    preamble, rest = path.read_text(encoding="utf-8-sig").split("\n", 1)
    path.write_text(preamble + "\n" * 125 + rest, encoding="utf-8-sig")
    assert read_monthly_directory(spark, str(tmp_path)).count() == 2
    path.write_text(preamble + "\n" * 125, encoding="utf-8-sig")
    with pytest.raises(ValueError, match="no header line"):
        read_monthly_directory(spark, str(tmp_path))


def test_one_header_row_per_file_goes(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{}, dict(zip(HEADER, HEADER)), dict(zip(HEADER, HEADER))])
    write_file(tmp_path, "VRA_20242.csv", [{}])
    found = sorted((row.ref_month, row.carrier) for row in read_monthly_directory(spark, str(tmp_path)).collect())
    name = "ICAO Empresa Aérea"
    assert found == [("2024-01", "GLO"), ("2024-01", name), ("2024-01", name), ("2024-02", "GLO")]


@pytest.mark.parametrize("multi_line", [False, True])
@pytest.mark.parametrize("preamble", [PREAMBLE, "", "  ", '"a;b'])
def test_only_the_header_in_its_place_goes(spark, tmp_path, preamble, multi_line):
    """Blank preambles, rows that repeat the header, and files that end with it."""
    if multi_line and preamble.startswith('"'):
        preamble += '"'  # an open quote would take in the lines after it
    header = dict(zip(HEADER, HEADER))
    for name, rows in (("VRA_20241.csv", [header, {}, header]), ("VRA_20242.csv", []), ("VRA_20243.csv", [header]), ("VRA_20244.csv", [{}])):
        write_file(tmp_path, name, rows)
        text = (tmp_path / name).read_text(encoding="utf-8-sig")
        gap = "\n \n" if name == "VRA_20243.csv" else "\n"
        (tmp_path / name).write_text(preamble + gap + text.split("\n", 1)[1], encoding="utf-8-sig")
    found = read_monthly_directory(spark, str(tmp_path), multi_line=multi_line).collect()
    name = "ICAO Empresa Aérea"
    expected = [("2024-01", "GLO"), ("2024-01", name), ("2024-01", name), ("2024-03", name), ("2024-04", "GLO")]
    assert sorted((row.ref_month, row.carrier) for row in found) == expected


def test_files_in_many_splits(spark, tmp_path):
    """A header-like row in any split but the first, files that share a task, and one scan in the plan."""
    header = dict(zip(HEADER, HEADER))
    write_file(tmp_path, "VRA_20241.csv", [{}] * 300 + [header] + [{}] * 300 + [header])
    for month in range(2, 8):
        write_file(tmp_path, f"VRA_2024{month}.csv", [header, {}])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "2000", "200"):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            frame = read_monthly_directory(spark, str(tmp_path))
            assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
            found = sorted((row.ref_month, row.carrier) for row in frame.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        name = "ICAO Empresa Aérea"
        assert len(found) == 602 + 12 and found.count(("2024-01", name)) == 2
        assert [month for month, carrier in found if carrier == name][2:] == [f"2024-{m:02d}" for m in range(2, 8)]


def test_headers_are_found_by_one_job(spark, tmp_path):
    def jobs(files):
        folder = tmp_path / str(files)
        folder.mkdir()
        for k in range(files):
            write_file(folder, f"VRA_2{k:03d}1.csv", [{}], HEADER if k % 2 else [*HEADER, f"Nota {k % 4}"])
        group = f"headers-{files}"
        spark.sparkContext.setJobGroup(group, group)
        columns = read_monthly_directory(spark, str(folder)).columns
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {"Nota 0", "Nota 2"} <= set(columns)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(4) == jobs(25) <= 3


def test_checks_are_filled_by_the_write(spark, tmp_path):
    from pyspark.sql import Observation

    rows = [{}, {"Partida Real": "x"}, {"Partida Real": ""}, {"ICAO Empresa Aérea": "NA", "Partida Real": "2024-02-30 00:00:00"}]
    raw = tmp_path / "raw"
    raw.mkdir()
    write_file(raw, "VRA_20241.csv", rows)
    write_file(raw, "VRA_20242.csv", [{"Chegada Prevista": "24:00"}], [*HEADER, "Nota"])
    checks = Observation("ingest")
    flights = read_monthly_directory(spark, str(raw), checks=checks)
    assert flights.columns == read_monthly_directory(spark, str(raw)).columns
    write_flights(flights, str(tmp_path / "flights"))
    found = checks.get
    assert {k: v for k, v in found.items() if v} == {"rows": 5, "refused_actual_dep": 2, "refused_sched_arr": 1, "missing_carrier": 1}
    stored = read_flights(spark, str(tmp_path / "flights"))
    assert stored.count() == found["rows"] and stored.where("carrier IS NULL").count() == found["missing_carrier"]


def test_header_with_repeated_and_empty_names_goes(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{}], [*HEADER, "Nota", "", "Nota"])
    rows = read_monthly_directory(spark, str(tmp_path)).collect()
    assert [row.carrier for row in rows] == ["GLO"] and "Nota.1" in rows[0].asDict()


def test_row_longer_than_header_in_all_columns_is_an_error(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{"Código Justificativa": "x;y"}])
    with pytest.raises(Exception, match="more fields than its header"):
        read_monthly_directory(spark, str(tmp_path)).collect()


def test_line_break_inside_quotes(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{"Situação Voo": '"NÃO\nINFORMADO"'}, {}])
    rows = read_monthly_directory(spark, str(tmp_path), multi_line=True).collect()
    assert sorted(row.status for row in rows) == ["NÃO\nINFORMADO", "REALIZADO"]


def test_file_without_rows(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [])
    write_file(tmp_path, "VRA_20242.csv", [{}])
    assert [row.ref_month for row in read_monthly_directory(spark, str(tmp_path)).collect()] == ["2024-02"]


def test_repeated_rows_are_kept(spark, tmp_path):
    write_file(tmp_path, "VRA_20241.csv", [{}, {}])
    write_file(tmp_path, "VRA_202401.csv", [{}])
    assert read_monthly_directory(spark, str(tmp_path)).count() == 3


def test_round_trip_of_the_fixture(spark, flights, tmp_path):
    """Monthly files written from the fixture and read back give the same flights."""
    from pyspark.sql import functions as F

    raw = tmp_path / "raw"
    raw.mkdir()
    names = {ours: source for ours, source in SOURCE_COLUMNS.items()}
    by_month = {}
    for row in flights.collect():
        by_month.setdefault(row.ref_month, []).append(
            {
                names[k]: "" if v is None else str(v)
                for k, v in row.asDict().items()
                if k != "ref_month"
            }
        )
    for month, rows in by_month.items():
        year, number = month.split("-")
        write_file(raw, f"VRA_{year}{int(number)}.csv", rows)
    table = str(tmp_path / "flights")
    write_flights(read_monthly_directory(spark, str(raw)), table)
    stored = read_flights(spark, table).select(*flights.columns)
    assert stored.schema["sched_dep"].dataType.typeName() == "timestamp_ntz"
    assert stored.count() == flights.count()
    assert stored.exceptAll(flights).isEmpty() and flights.exceptAll(stored).isEmpty()
    # A year selection opens only that year's partitions.
    plan = stored.where(F.substring("ref_month", 1, 4) == "2024")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ref_month" in text and "= 2024)" in text
