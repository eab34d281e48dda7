import hashlib
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from riverlake.operators import versions as v
from riverlake.operators.readings import ReadingFilter
from riverlake.session import scratch_dir
from riverlake.sources import fs, lake
from riverlake.sources.stores import list_files
from tests.helpers import readings

ROWS = [
    (f"USGS-{s}", "00060", f"{y}-0{m}-01", float(s * y * m), f"2025-0{m}-01 00:00:00.5")
    for s in range(4)
    for y in (2022, 2023, 2024)
    for m in range(1, 7)
]


@pytest.fixture(scope="module")
def root(spark):
    root = scratch_dir(spark, "test-lake")
    lake.append_readings(readings(spark, ROWS), root, "daily")
    lake.append_readings(readings(spark, ROWS[:20]), root, "daily")
    return root


def files(spark, *rows):
    return spark.createDataFrame(rows, "n bigint, path string, sha256 string, row_count bigint")


def plain_hash(entries):
    lines = "".join(f"{p}:{h}\n" for p, h in sorted((p.encode(), h) for p, h in entries) for p in [p.decode()])
    return hashlib.sha256(lines.encode()).hexdigest()


def test_content_hash_does_not_depend_on_order(spark):
    rows = [(1, "b.parquet", "hash-b", 1), (1, "a.parquet", "hash-a", 1)]
    expected = plain_hash([r[1:3] for r in rows])
    for order in (rows, rows[::-1]):
        assert v.content_hashes(files(spark, *order), "n").first().content_hash == expected


def test_content_hashes_of_many_versions_over_many_batches(spark):
    dice = random.Random(1)
    rows = [
        (0 if i % 3 == 0 else dice.randrange(1, 40), f"é/{dice.randrange(10**9)}-{i}", f"h{i}", 1)
        for i in range(5000)
    ]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        found = {r.n: r.content_hash for r in v.content_hashes(files(spark, *rows), "n").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {}
    for n, path, sha, _ in rows:
        groups.setdefault(n, []).append((path, sha))
    assert found == {n: plain_hash(g) for n, g in groups.items()}


def test_null_and_nan_keys_are_one_group_at_any_batch_size(spark):
    rows = [(None, f"p{i}", f"h{i}") for i in range(7)] + [(1, "q", "h")]
    expected = plain_hash([(f"p{i}", f"h{i}") for i in range(7)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for kind, nothing in (("bigint", None), ("string", None), ("double", float("nan"))):
                df = spark.createDataFrame(
                    [(str(k) if k and kind == "string" else float(k) if k and kind == "double" else k if k else nothing, *r) for k, *r in rows],
                    f"k {kind}, path string, sha256 string",
                )
                found = v.content_hashes(df, "k").collect()
                assert [r.n_files for r in found if r.n_files > 1] == [7] and len(found) == 2
                assert {r.content_hash for r in found if r.n_files == 7} == {expected}
                assert dict(v.content_hashes(df, "k").dtypes)["k"] == kind
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_file_hashes(spark, tmp_path):
    contents = {"a.bin": b"hello world", "sub folder/b%c.bin": os.urandom(3000), "c": b"x"}
    contents |= {"empty": b"", ".hidden": b"h", "_under": b"u", "big.gz": os.urandom(9 << 20)}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = v.file_hashes(spark, str(tmp_path)).collect()
    assert {r.path: r.sha256 for r in rows} == {
        name: hashlib.sha256(content).hexdigest() for name, content in contents.items()
    }


def test_totals(spark):
    rows = [(1, "b", "hb", 3), (1, "a", "ha", 4), (2, "a", "ha", 5)]
    found = {r.n: (r.row_count, r.n_files) for r in v.manifest_totals(files(spark, *rows), "n").collect()}
    assert found == {1: (7, 2), 2: (5, 1)}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_previous_version_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(v, "BLOCK_VERSIONS", block)
    dice = random.Random(block)
    numbers = {"hot": sorted(dice.sample(range(1, 400), 200)), "cold": [3, 50]}
    rows = [(d, n, f"{d}{n}") for d, ns in numbers.items() for n in ns]
    df = spark.createDataFrame(rows, "dataset string, n bigint, content_hash string")
    found = {
        (r.dataset, r.n): r.previous
        for r in v.with_previous(df.repartition(5), "dataset", "content_hash", "previous").collect()
    }
    assert found == {
        (d, n): f"{d}{ns[i - 1]}" if i else None
        for d, ns in numbers.items()
        for i, n in enumerate(ns)
    }


def test_version_names_and_chain(spark):
    names = ["v1-ab", "v10-cd", "v2-ef", "x", "v3-pending", "v-9", "vx-1"]
    parents = {"v2-ef": "v1-ab", "v10-cd": "v3-pending"}
    df = spark.createDataFrame(
        [("d", n, n, parents.get(n)) for n in names],
        "dataset string, dir_name string, content_hash string, parent_hash string",
    )
    history = v.version_history(df).orderBy("n").collect()
    assert [(r.n, r.dir_name, r.chain_ok) for r in history] == [
        (1, "v1-ab", True),
        (2, "v2-ef", True),
        (10, "v10-cd", False),
    ]


def test_provenance(spark):
    df = readings(spark, [("b", "p", "2024-01-01", 1.0, "2024-02-01"), ("a", "p", "2024-01-02", 2.0)])
    row = v.provenance(df).first()
    assert (row.row_count, row.sites) == (2, ["a", "b"])
    assert row.approval_status_counts == {"Approved": 2}
    assert row.max_last_modified == "2024-02-01T00:00:00.000000Z"
    nothing = v.provenance(df.filter("false")).first()
    assert (nothing.row_count, nothing.sites, nothing.max_last_modified) == (0, [], "")


def test_publish_verify_and_chain(spark, root):
    target = scratch_dir(spark, "test-published")
    first = v.publish(spark, root, target, ReadingFilter(end="2023-12-31"), " flow ").first()
    second = v.publish(spark, root, target, ReadingFilter(), "flow").first()
    assert (first.n, first.parent_hash, first.row_count) == (1, None, 48)
    assert (second.n, second.parent_hash, second.row_count) == (2, first.content_hash, 72)
    assert second.sites == ["USGS-0", "USGS-1", "USGS-2", "USGS-3"]
    assert (first.end, second.end, second.max_last_modified) == (
        "2023-12-31",
        "",
        "2025-06-01T00:00:00.500000Z",
    )
    folder = f"{target}/flow/{second.dir_name}"
    assert sorted(fs.file_names(spark, folder)) == ["data-00000.parquet", "manifest.json"]
    with open(f"{folder}/data-00000.parquet", "rb") as file:
        sha = hashlib.sha256(file.read()).hexdigest()
    assert second.dir_name == f"v2-{second.content_hash[:8]}"
    assert second.content_hash == plain_hash([("data-00000.parquet", sha)])
    stored = [r.datetime for r in lake.read_export(spark, folder, "daily").collect()]
    assert len(stored) == 72
    report = v.verify_published(spark, target, "flow", second.dir_name).first()
    assert (report.ok, report.content_hash_ok, report.row_count_ok) == (True, True, True)
    assert report.actual_hash == second.content_hash
    assert [r.chain_ok for r in v.versions(spark, target, "flow").collect()] == [True, True]


def test_published_bytes_depend_on_the_readings_alone(spark, root):
    hashes, names = set(), set()
    for partitions in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            target = scratch_dir(spark, "test-published")
            row = v.publish(spark, root, target, ReadingFilter(), "d", rows_per_file=10).first()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        hashes.add(row.content_hash)
        names.add(row.dir_name)
        folder = f"{target}/d/{row.dir_name}"
        assert row.dir_name == f"v1-{row.content_hash[:8]}"
        assert len(fs.file_names(spark, folder)) > 3
        assert lake.read_export(spark, folder, "daily").distinct().count() == 72
        assert v.verify_version(spark, folder).first().ok
    assert len(hashes) == len(names) == 1


def test_publish_refuses_blank_names_and_empty_results(spark, root):
    target = scratch_dir(spark, "test-published")
    with pytest.raises(ValueError, match="needs a name"):
        v.publish(spark, root, target, ReadingFilter(), "  ")
    with pytest.raises(ValueError, match="no version to publish"):
        v.publish(spark, root, target, ReadingFilter(param_cd="99999"), "d")
    assert fs.subfolders(spark, f"{target}/d") == []
    assert v.versions(spark, target, "d").collect() == []


def test_unfinished_version_is_replaced(spark, root):
    target = scratch_dir(spark, "test-published")
    os.makedirs(f"{target}/d/v1-pending")
    with open(f"{target}/d/v1-pending/data.parquet", "w") as file:
        file.write("half")
    row = v.publish(spark, root, target, ReadingFilter(), "d").first()
    assert (row.n, row.row_count) == (1, 72)


def test_publishers_at_the_same_time_take_turns(spark, root):
    target = scratch_dir(spark, "test-published")
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(v.publish, spark, root, target, ReadingFilter(end=e), "d") for e in (None, "2023-06-01")]
        assert sorted(job.result().first().n for job in jobs) == [1, 2]
    history = v.versions(spark, target, "d").collect()
    assert [r.chain_ok for r in history] == [True, True]
    assert [r.dir_name for r in history] == sorted(fs.subfolders(spark, f"{target}/d"))
    assert fs.file_names(spark, f"{target}/d") == []


def test_a_claim_that_stays_is_reported(spark, root):
    target = scratch_dir(spark, "test-published")
    assert fs.create_new(spark, f"{target}/d/.v1.claim") and not fs.create_new(spark, f"{target}/d/.v1.claim")
    with pytest.raises(TimeoutError, match="v1.claim"):
        v.publish(spark, root, target, ReadingFilter(), "d", claim_wait=0.5)
    assert v.versions(spark, target, "d").collect() == [] and fs.subfolders(spark, f"{target}/d") == []


def test_manifest_is_streamed_from_rows(spark):
    folder = scratch_dir(spark, "test-manifest")
    os.makedirs(folder, exist_ok=True)
    rows = [(1, f"é\"{i:05d}", f"h{i}", i) for i in range(3000)]
    held = spark.createDataFrame([(3, ["A"], {"x": 3}, "m")], "row_count long, sites array<string>, approval_status_counts map<string,long>, max_last_modified string").first()
    for some in (rows, []):
        table = files(spark, *some) if some else files(spark, rows[0]).limit(0)
        head = v.manifest_head(table, held, ReadingFilter(), None, created_at="now")
        v.write_manifest(table, folder, head)
        with open(f"{folder}/manifest.json", encoding="utf-8") as file:
            written = json.load(file)
        assert [(f["path"], f["sha256"], f["row_count"]) for f in written["files"]] == [r[1:] for r in some]
        assert written["content_hash"] == plain_hash([r[1:3] for r in some])
        assert v.read_manifests(spark, [folder]).first().row_count == sum(r[3] for r in some)
        os.remove(f"{folder}/manifest.json")


def test_files_of_all_levels_are_listed_by_tasks(spark, tmp_path):
    names = {"a", ".hidden", "x=1/b c", "x=1/y/é", "x=1/y/.z/empty", "_tmp/d"}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "x=1" / ".b c.crc").write_bytes(b"")
    listed = list_files(spark, str(tmp_path)).collect()
    assert {r.path for r in listed} == names and len(listed) == len(names)


def write_version(folder, content, **changes):
    os.makedirs(folder)
    with open(f"{folder}/data.bin", "wb") as file:
        file.write(content)
    sha = hashlib.sha256(content).hexdigest()
    manifest = {
        "content_hash": plain_hash([("data.bin", sha)]),
        "parent_hash": None,
        "created_at": "2025-01-01T00:00:00Z",
        "generator": "test",
        "source": {"collection": "x", "sites": [], "param_cd": "x", "start": "", "end": ""},
        "upstream_state": {"max_last_modified": "", "approval_status_counts": {}},
        "row_count": 5,
        "files": [{"path": "data.bin", "sha256": sha, "row_count": 5}],
    } | changes
    with open(f"{folder}/manifest.json", "w") as file:
        json.dump(manifest, file, indent=2)


def test_verify_finds_changed_and_missing_files(spark, tmp_path):
    folder = str(tmp_path / "v1-x")
    write_version(folder, b"hello world")
    assert v.verify_version(spark, folder).first().ok
    with open(f"{folder}/data.bin", "wb") as file:
        file.write(b"corrupted!!")
    report = v.verify_version(spark, folder).first()
    assert (report.ok, report.n_mismatched) == (False, 1)
    (file,) = v.mismatched_files(spark, folder).collect()
    assert (file.path, file.actual_sha256) == ("data.bin", hashlib.sha256(b"corrupted!!").hexdigest())
    os.remove(f"{folder}/data.bin")
    report = v.verify_version(spark, folder).first()
    assert (report.ok, report.n_mismatched) == (False, 1)
    assert [r.actual_sha256 for r in v.mismatched_files(spark, folder).collect()] == [""]
    assert report.actual_hash == plain_hash([("data.bin", "")])


def test_verify_looks_at_the_statement_separately(spark, tmp_path):
    folder = str(tmp_path / "v1-x")
    write_version(folder, b"hello world", content_hash="0", row_count=6)
    report = v.verify_version(spark, folder).first()
    assert (report.ok, report.content_hash_ok, report.row_count_ok) == (True, False, False)


def test_version_without_manifest_is_an_error(spark, tmp_path):
    os.makedirs(tmp_path / "d" / "v1-x")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        v.versions(spark, str(tmp_path), "d").collect()


def test_wrong_row_counts_are_found_in_the_footers(spark, root):
    target = scratch_dir(spark, "test-published")
    row = v.publish(spark, root, target, ReadingFilter(), "d").first()
    path = f"{target}/d/{row.dir_name}/manifest.json"
    with open(path) as file:
        manifest = json.load(file)
    manifest["files"][0]["row_count"] += 1
    manifest["row_count"] += 1
    with open(path, "w") as file:
        json.dump(manifest, file)
    report = v.verify_published(spark, target, "d", row.dir_name).first()
    assert (report.ok, report.content_hash_ok, report.row_count_ok) == (True, True, False)


def test_a_store_of_the_callers_choice(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")

    def open_store(path):
        from pyarrow import fs as stores

        return stores.LocalFileSystem(), path.removeprefix("file:")

    (row,) = v.file_hashes(spark, str(tmp_path), open_store).collect()
    assert row.sha256 == hashlib.sha256(b"x").hexdigest()
