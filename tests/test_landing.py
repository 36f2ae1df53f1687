"""Reading provider files with their checks: header, rejected lines, required columns, number of lines."""

import json
import re

import pytest
from tests.test_load import AS_OF, amazon_file, amazon_row, statuses, write_file

from tillroll.operators.staging import clean_raw
from tillroll.plans.load import FileLoad, LoadRefused, load_file
from tillroll.sources.landing import SEPARATORS, check_header, land_checked, parse_json, parse_text, with_required
from tillroll.sources.schemas import PROVIDERS, raw_widths


@pytest.mark.parametrize("provider", PROVIDERS)
def test_headers_match_by_normalised_names_in_order(provider):
    sep, names = SEPARATORS[provider], list(raw_widths(provider))
    check_header(sep.join(names), provider)
    check_header("﻿" + sep.join(f'"{n.replace("_", " ").title()} "' for n in names), provider)
    swapped = [names[1], names[0], *names[2:]]
    with pytest.raises(ValueError, match="another order from column 1"):
        check_header(sep.join(swapped), provider)
    with pytest.raises(ValueError, match="lacks"):
        check_header(sep.join(names[:-1]), provider)
    with pytest.raises(ValueError, match="has .*extra"):
        check_header(sep.join([*names, "extra"]), provider)
    with pytest.raises(ValueError, match="lacks"):
        check_header("", provider)


def test_lines_parse_as_columns(spark):
    names = list(raw_widths("roku"))
    whole = ",".join(f'"{n}, ""q"""' if i == 0 else "" if i == 1 else n for i, n in enumerate(names))
    lines = spark.createDataFrame([(whole,), (whole + ",more",), ("one,two",)], "value string")
    rows = parse_text(lines, "roku").collect()
    good = [r for r in rows if r._reject is None]
    assert len(good) == 1 and good[0][names[0]] == f'{names[0]}, "q"' and good[0][names[1]] is None
    assert sorted(r._reject for r in rows if r._reject) == sorted(["one,two", whole + ",more"])
    objects = ['{"transaction_id": "b1", "items": {"item_id": "x"}}', '{"transaction_id": ', "[1]"]
    parsed = parse_json(spark.createDataFrame([(x,) for x in objects], "value string"))
    reasons = [(r.transaction_id, r.items_item_id, r._reason) for r in with_required(parsed, ["transaction_id"]).collect()]
    assert sorted(reasons, key=str) == sorted([("b1", "x", None), (None, None, "fields"), (None, None, reasons[2][2])], key=str)
    assert reasons[2][2] is not None


def test_a_line_is_landed_or_rejected(spark, tmp_path):
    path = amazon_file(tmp_path, 5, [amazon_row(1), {**amazon_row(2), "receipt_id": " "}])
    with open(path, "a") as file:
        file.write("broken,line\n\n")
    good, bad = land_checked(spark, "amazon", path, "f", "run", ["receipt_id"])
    assert [(r.transaction_id, r.file_tx_id, r.load_tx_id) for r in good.collect()] == [("t1", "f", "run")]
    assert sorted(r.reason for r in bad.collect()) == ["fields", "missing receipt_id"]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="no header"):
        land_checked(spark, "amazon", str(empty), "f", "run")


def test_a_swapped_header_refuses_the_load(tables, tmp_path):
    names = list(raw_widths("amazon"))
    path = tmp_path / "amazon_go_sales_2024-01-05.csv"
    path.write_text(",".join([names[1], names[0], *names[2:]]) + "\n" + ",".join(["x"] * len(names)) + "\n")
    with pytest.raises(ValueError, match="another order"):
        load_file(tables, FileLoad("amazon", "AMER", str(path), "d5", as_of=AS_OF))
    assert statuses(tables) == {"d5": "LOAD_ERROR"} and tables.read("payments").count() == 0


def test_guards_of_a_load(tables, tmp_path):
    path = amazon_file(tmp_path, 5, [amazon_row(1), amazon_row(2)])
    with open(path, "a") as file:
        file.write("broken,line\n")

    def load(**more):
        return load_file(tables, FileLoad("amazon", "AMER", path, "d5", as_of=AS_OF, **more))

    with pytest.raises(LoadRefused, match="1 lines rejected"):
        load()
    assert statuses(tables) == {"d5": "LOAD_ERROR"}
    assert [r.line for r in tables.read("rejects").collect()] == ["broken,line"]
    with pytest.raises(LoadRefused, match="3 lines, 4 expected"):
        load(most_rejects=1, expected_rows=4)
    assert load(most_rejects=1, expected_rows=3).staged_rows == 2
    assert statuses(tables) == {"d5": "LOADED_FACT"} and tables.read("rejects").count() == 1


def test_json_lines_load_with_their_rejects(tables, tmp_path):
    path = tmp_path / "billing.json"
    path.write_text('{"transaction_id": "b1", "amount": "100", "currency": "USD", "charged_timestamp": "2024-01-05 10:00:00"}\nnot json\n')
    result = load_file(tables, FileLoad("direct_billing", "AMER", str(path), "b", as_of=AS_OF, most_rejects=1))
    assert (result.status, result.staged_rows) == ("LOADED_FACT", 1)
    assert [(r.line, r.reason) for r in tables.read("rejects").collect()] == [("not json", "fields")]


def test_an_empty_file_with_a_header_loads_nothing(tables, tmp_path):
    path = write_file(tmp_path, "roku.csv", "roku", [])
    assert load_file(tables, FileLoad("roku", "AMER", path, "r", as_of=AS_OF)).staged_rows == 0


def test_cleaning_compiles_and_keeps_its_rules(spark):
    """Methods of more than 8000 bytes run interpreted in the JVM."""
    names = list(raw_widths("direct_billing"))
    width = raw_widths("direct_billing")[names[0]]
    values = [" \t\r\n", "", None, "é" * (width + 1), " " * width + "x", " a "]
    lines = spark.createDataFrame([(json.dumps({names[0]: v}),) for v in values], "value string")
    cleaned = clean_raw(parse_json(lines), "direct_billing")
    assert [r[0] for r in cleaned.collect()] == [None, None, None, "é" * width, " " * width, " a "]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", cleaned._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) < 8000
