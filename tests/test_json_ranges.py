"""Large JSON files in ranges against the whole-file parser, and what damaged files do."""

import json
import random

import pytest

from corvane.sources.corpus import read_corpus
from corvane.sources.json_ranges import _step, read_json_records

SCHEMA = "code string, docstring string, language string, func_name string"


def records(n, seed=1):
    rng = random.Random(seed)
    odd = ["}", "{", '"', "\\", '\\"', "]", "[", ",", "é", "日本", "\n", "\t", 'a "quoted" {brace}', "\\\\", "}}}", '{"code": "inner"}', "x" * 50]
    return [{"code": "".join(rng.choices(odd, k=rng.randrange(12))), "docstring": rng.choice(odd), "language": rng.choice(["python", "java"]), "func_name": f"f{k}", "extra": {"deep": [{"a": 1}, [2, {"b": "}"}]]}} for k in range(n)]


def rows(df):
    return sorted((r.func_name, r.code, r.docstring, r.language) for r in df.collect())


def want(items):
    return sorted((r["func_name"], r["code"], r["docstring"], r["language"]) for r in items)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent,ascii_only", [(2, True), (None, False)])
def test_array_in_ranges_equals_the_whole_file(spark, tmp_path, small_ranges, indent, ascii_only):
    items = records(60)
    items[30]["code"] = "long { } \" text " * 200  # a record over several ranges
    file = tmp_path / "a.json"
    file.write_text(json.dumps(items, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    df = read_json_records(spark, str(file), SCHEMA)
    assert rows(df) == want(items)
    read = spark.read.option("lineSep", "}").text(str(file)).selectExpr("_metadata.file_block_start AS s").distinct().count()
    assert read > 10  # ranges, and so tasks


def test_many_files_and_objects_without_an_array(spark, tmp_path, small_ranges):
    items = records(40, 2)
    (tmp_path / "a.json").write_text(json.dumps(items[:25]))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in items[25:33]))
    (tmp_path / "c.json").write_text("  " + json.dumps(items[33:39], indent=1) + "\n\n")
    (tmp_path / "d.json").write_text(json.dumps(items[39]))
    for name, text in (("e", "[]"), ("f", ""), ("g", " [ ] \n"), ("h", "  \n")):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "other.txt").write_text("not JSON")
    assert rows(read_corpus(spark, str(tmp_path))) == want(items)


DAMAGED = ['[{"code": "a"}, {"code": ', '[{"code": "a"}', '[{"code": "a"}, 5]', '[{"code": "a"} {"code": "b"}]', '{"code": "a"', '[{"code": a}]', '[{"code": "a"}]]', '[{"code": "a"}] {"code": "b"}', "nothing", "[", '[{"code": "a}]', '[,{"code": "a"}]']


@pytest.mark.parametrize("text", DAMAGED)
def test_damaged_files_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_json_records(spark, str(tmp_path), SCHEMA).collect()


def test_other_modes(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"code": "a"}, {"code": b}, {"code": "c"}]')
    assert sorted(str(r.code) for r in read_json_records(spark, str(tmp_path), SCHEMA, "PERMISSIVE").collect()) == ["None", "a", "c"]
    assert sorted(str(r.code) for r in read_json_records(spark, str(tmp_path), SCHEMA, "DROPMALFORMED").collect()) == ["a", "c"]


def test_steps_compose():
    text = json.dumps(records(30, 3))
    for cut in range(0, len(text), 17):
        for inside in (0, 1):
            whole = _step(text, inside)
            if not cut or text[cut - 1] == "\\" or text[:cut].endswith("\\"):
                continue
            state, deeper = _step(text[:cut], inside)
            after, more = _step(text[cut:], state)
            assert (after, deeper + more) == whole
