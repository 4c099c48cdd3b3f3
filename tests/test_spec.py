import json

import pytest

from city import specs
from weftline.plans import run
from weftline.plans.spec import DatasetSpec, Platform, snake_case, standard_names, with_parameters

DATASET = {"format": "parquet", "source_path": "/x/*.parquet", "required": ["LocationID", "Borough"], "key": ["location_id"], "rename": {"LocationID": "location_id"}, "casts": {"location_id": "int"}, "rules": {"r": "location_id > :least"}, "parameters": {"least": 0}}
PLATFORM = {"platform": {"version": "1", "root": "/t"}, "session": {"shuffle_partitions": 4, "adaptive": True}, "datasets": {"zones": DATASET}}


def test_names():
    assert [snake_case(c) for c in ("PULocationID", "Airport_fee", "Site Num", "tpepPickup")] == ["pulocation_id", "airport_fee", "site_num", "tpep_pickup"]
    assert standard_names(["A B", "c"], {"c": "d"}) == ["a_b", "d"]
    with pytest.raises(ValueError, match="share a name"):
        standard_names(["A B", "a_b"], {})


def test_parameters():
    assert with_parameters("x IN :l AND y = :s AND z::int = {1}", {"l": [1, 2], "s": "it's"}) == "x IN (1, 2) AND y = 'it\\'s' AND z::int = {1}"
    with pytest.raises(ValueError, match="nope"):
        with_parameters("x > :nope", {})


@pytest.mark.parametrize(
    "change",
    [
        {"format": "xlsx"}, {"source_path": " "}, {"timezone": ""}, {"required": []}, {"required": ["A", "A"]}, {"key": []}, {"key": "id"},
        {"rename": []}, {"casts": {"nope": "int"}}, {"casts": {"location_id": "decimal"}}, {"rules": {"r": ""}}, {"rules": {"r": "a > :gone"}},
        {"selected": []}, {"partition_by": ["a", "a"]}, {"unknown": 1}, {"rules": None}, {"parameters": 3},
    ],
)
def test_broken_datasets(change):
    with pytest.raises(ValueError):
        DatasetSpec.of("zones", {**DATASET, **change})


@pytest.mark.parametrize(
    "change",
    [
        {"platform": {"version": "", "root": "/t"}}, {"platform": None}, {"session": {"shuffle_partitions": 0}}, {"session": {"shuffle_partitions": True}},
        {"session": {"adaptive": 1}}, {"session": {"nope": 1}}, {"datasets": {}}, {"datasets": {"zones": 3}}, {"iterations": 5}, {"integration": 3}, {"integration": {}}, {"benchmark": {"root": "/b"}}, {"datasets": {"zones": DATASET, "a/../zones": DATASET}},
    ],
)
def test_broken_platforms(change):
    with pytest.raises(ValueError):
        Platform.of({**PLATFORM, **change})
    with pytest.raises(ValueError):
        Platform.of([])


def test_loads_yaml(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text(json.dumps(PLATFORM))
    assert Platform.load(str(path)).datasets["zones"].sql("location_id > :least") == "location_id > 0"


def test_specifications_are_valid():
    assert {n: f("/x").name for n, f in specs.ALL.items()} == {n: n for n in specs.ALL}


def test_json_replaces_whole(tmp_path):
    run.write_json({"a": 1}, tmp_path / "s" / "latest.json")
    run.write_json({"a": 2}, tmp_path / "s" / "latest.json")
    assert json.loads((tmp_path / "s" / "latest.json").read_text()) == {"a": 2} and len(list((tmp_path / "s").iterdir())) == 1


def test_one_handler_a_name():
    assert len(run.logger("t").handlers) == 1 and len(run.logger("t").handlers) == 1


FOUR = {**PLATFORM, "datasets": {n: DATASET for n in ("taxi_trips", "taxi_zones", "weather", "other")}}
ROLES = {"air": "other", "partition_by": ["pickup_year"]}


def test_integration_and_benchmark():
    made = Platform.of({**FOUR, "integration": ROLES, "benchmark": {"root": "/t/layouts", "iterations": 2}})
    assert made.integration.roles["air"] == "other" and made.integration.partition_by == ("pickup_year",) and made.benchmark.iterations == 2
    assert "/t/silver/integrated" in made.outputs() and "/t/layouts" in made.outputs()


@pytest.mark.parametrize(
    "change",
    [
        {"integration": {}}, {"integration": {"air": "gone"}}, {"integration": {**ROLES, "partition_by": ["a", "a"]}}, {"integration": {**ROLES, "nope": 1}},
        {"benchmark": {}}, {"benchmark": {"root": " "}}, {"benchmark": {"root": "/b", "iterations": 0}}, {"benchmark": {"root": "/b", "iterations": True}}, {"benchmark": {"root": "/b", "nope": 1}},
        {"benchmark": {"root": "/t/silver/../silver/integrated"}}, {"benchmark": {"root": "/t/silver"}}, {"benchmark": 3},
    ],
)
def test_broken_integration_and_benchmark(change):
    with pytest.raises(ValueError):
        Platform.of({**FOUR, "integration": ROLES, **change})
