"""One JSON array file read by many tasks: the same rows at every split size."""

import json
import random

import pytest


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.fixture
def splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def set_to(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")
    yield set_to
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_objects_are_the_same_at_every_split_size(spark, tmp_path, splits):
    from vellum.sources.json_array import read_json_array
    rng = random.Random(4)
    strings = ["plain", "brace } in", "open { in", 'quote " in', "back \\ slash", "\\", '\\"}', "}{", "é 中 🙂", "", "line\nbreak", '"}', "a\\\\"]

    def value(depth):
        kind = rng.randrange(4 if depth else 2)
        return rng.choice(strings) if kind == 0 else rng.randrange(100) if kind == 1 else {rng.choice(strings) + str(i): value(depth - 1) for i in range(rng.randrange(3))} \
            if kind == 2 else [value(depth - 1) for _ in range(rng.randrange(3))]

    items = [{"id": i, "v": value(3), "w": {}} for i in range(120)]
    for name, text in (("compact", json.dumps(items, separators=(",", ":"))), ("pretty", json.dumps(items, indent=2, ensure_ascii=False) + "\n"), ("one", json.dumps(items[:1]))):
        path = write(tmp_path / f"{name}.json", text)
        for size in (61, 400, 1 << 20):
            splits(size)
            df = read_json_array(spark, path)
            got = [json.loads(r["json"]) for r in df.orderBy("n").collect()]
            assert got == json.loads(text), (name, size)


def test_empty_arrays_and_files_that_are_none(spark, tmp_path, splits):
    from vellum.sources.json_array import read_json_array
    splits(7)
    assert read_json_array(spark, write(tmp_path / "e.json", " [ ]\n")).count() == 0
    for i, bad in enumerate(['{"a": 1}', '[{"a": 1}', 'null', '{"a": 1},{"b": 2}]', '[{"a": 1} {"b": 2}]']):
        with pytest.raises(Exception, match="expected an array"):
            read_json_array(spark, write(tmp_path / f"b{i}.json", bad)).collect()


def test_backup_by_splits_equals_the_whole_file_reader(spark, tmp_path, splits):
    from conftest import SF_SMALL
    from vellum.plans.derived import library
    from vellum.sources.library_io import export_backup, read_backup
    path = export_backup(library(spark, SF_SMALL).limit(80).coalesce(1), str(tmp_path / "backup"))
    want = sorted(r.json for r in read_backup(spark, path).selectExpr("to_json(struct(*)) AS json").collect())
    splits(5000)
    got = sorted(r.json for r in read_backup(spark, path, split=True).selectExpr("to_json(struct(*)) AS json").collect())
    assert got == want and len(got) == 80
