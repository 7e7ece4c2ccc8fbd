import random
import subprocess
import sys

import pytest

from stratalog.llm import history
from stratalog.llm.history import History, artifact_members, artifact_records, repeats


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(history, "BUCKET_ROWS", 400)


def tables(spark, sets, sha=None, day=None):
    """Artifacts whose set of objects is given; None has no pages."""
    a, p, m, page = [], [], [], 0
    for i, s in enumerate(sets):
        a.append((i, (sha or {}).get(i, f"{i:064x}"), (day or {}).get(i, f"2023-01-{1 + i % 9:02}T23:00:00-05:00")))
        if s is not None:
            page += 1
            p.append((page, i))
            m += [(page, o) for o in s] + [(page, o) for o in list(s)[:1]]
    return (
        spark.createDataFrame(a, "artifact_id bigint, sha256 string, accepted_at string"),
        spark.createDataFrame(p, "page_id bigint, artifact_id bigint"),
        spark.createDataFrame(m, "page_id bigint, source_object_sha256 string"),
    )


def brute(sets):
    out = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                out.add((j, i))
    return out


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_against_brute_force(spark, steps):
    r = random.Random(5)
    sets = []
    for _ in range(60):
        if sets and r.random() < 0.6:
            s = set(r.choice([x for x in sets if x]))
            for _ in range(r.randrange(3)):
                s ^= {f"o{r.randrange(400)}"}
            sets.append(s)
        else:
            sets.append({f"o{r.randrange(400)}" for _ in range(r.randrange(1, 25))})
    got = [tuple(x) for x in repeats(*tables(spark, sets), steps).collect()]
    assert set(got) == brute(sets) and len(got) == len(set(got))


def test_digests_however_written_and_missing_sets(spark):
    h = "ab" * 32
    sets = [None, None, None, {"o"}, {"o"}, None, None]
    sha = {0: h, 1: f" SHA256:{h.upper()}\n", 2: None, 3: h, 5: None, 6: ""}
    day = {0: "garbage", 1: "2023-01-01T00:00:00Z", 3: "2023-05-05T10:00:00.123456+03:00"}
    a, p, m = tables(spark, sets, sha, day)
    m = m.unionByName(spark.createDataFrame([(1, None)], m.schema))
    for steps in (1, 3):
        assert {tuple(x) for x in repeats(a, p, m, steps).collect()} == {(0, 1), (0, 3), (1, 3), (3, 4)}


def test_copies_and_neighbours_of_known_sets_are_found_in_later_batches(spark):
    base = {f"o{i}" for i in range(10)}
    near = base - {"o0"}
    a, p, m = tables(spark, [base, near, base, near, {"z"}])
    records, members = artifact_records(a).drop("batch"), artifact_members(p, m)
    h, found = History(spark), []
    for ids in ([0, 1], [2], [], [3, 4]):
        found.append({tuple(x) for x in h.accept(records.where(records.artifact_id.isin(ids) if ids else "false"), members).pairs().collect()})
    assert found == [{(0, 1)}, {(0, 2), (1, 2)}, set(), {(0, 3), (1, 3), (2, 3)}]


def test_a_crowd_with_a_common_object(spark, monkeypatch):
    """Many small sets share one object, and so band keys; none of their pairs are candidates for that alone."""
    monkeypatch.setattr(history, "HOT_KEY", 4)
    r = random.Random(2)
    sets = [{"all", *(f"o{r.randrange(300)}" for _ in range(4))} for _ in range(70)]
    sets += [s - {max(s)} | {"x"} for s in sets[:3]] + [s | {"y"} for s in sets[:6]]
    for steps in (1, 3):
        assert {tuple(x) for x in repeats(*tables(spark, sets), steps).collect()} == brute(sets)


CHILD = """
import sys
from pyspark.sql import SparkSession
from stratalog.llm.history import History
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
base = sys.argv[1]
h = History(spark, base + "/history")
for k in map(int, sys.argv[2].split(",")):
    got = h.accept(spark.read.parquet(base + "/records").where(f"artifact_id % 3 = {k}"), spark.read.parquet(base + "/members"))
print("STATES", sorted(tuple(r) for r in got.artifacts.select("artifact_id", "state").collect()))
print("PAIRS", sorted(tuple(r) for r in h.pairs().collect()))
"""


def test_another_process_goes_on(spark, tmp_path):
    base = {f"o{i}" for i in range(10)}
    sets = [base, {"p", "q", "r", "s", "t"}, base - {"o0"}, base, {"p", "q", "r", "s"}, {"z"}]
    a, p, m = tables(spark, sets, sha={5: f"{0:064x}"})
    artifact_records(a).drop("batch").write.parquet(f"file://{tmp_path}/records")
    artifact_members(p, m).write.parquet(f"file://{tmp_path}/members")
    out = [subprocess.run([sys.executable, "-c", CHILD, f"file://{tmp_path}", k], capture_output=True, text=True, timeout=300, check=True).stdout for k in ("0", "1,2")]
    want = sorted(brute(sets) | {(0, 5)})
    assert f"PAIRS {want}" in out[1] and "STATES [(0, 'new'), (3, 'copy')]" in out[0]
    assert "STATES [(2, 'near'), (5, 'copy')]" in out[1]
    h = History(spark, f"file://{tmp_path}/history")
    assert h.steps == 3 and [tuple(x) for x in h.pairs().orderBy("first_artifact_id", "second_artifact_id").collect()] == want
    stale = History(spark, f"file://{tmp_path}/history")
    h.accept(artifact_records(a).drop("batch").where("false"), artifact_members(p, m))
    with pytest.raises(history.Conflict):
        stale.accept(artifact_records(a).drop("batch").where("false"), artifact_members(p, m))


def test_many_batches_merge_and_read_little(spark, monkeypatch):
    monkeypatch.setattr(history, "BUCKET_ROWS", 16)
    monkeypatch.setattr(history, "MERGED", 3)
    sets = [{f"o{10 * i + k}" for k in range(6)} for i in range(40)] + [{f"o{k}" for k in range(6)}]
    a, p, m = tables(spark, sets)
    records, members = artifact_records(a).drop("batch"), artifact_members(p, m)
    h = History(spark)
    for lo, hi in ((0, 30), (30, 33), (33, 36), (36, 40), (40, 41)):
        last = h.accept(records.where(f"artifact_id >= {lo} and artifact_id < {hi}"), members)
    assert [tuple(x) for x in last.pairs().collect()] == [(0, 40)]
    assert all(len(x) <= 4 for x in h.parts.values())
    assert last.before.read["members"] < 0.3 * last.before.bytes("members") if "members" in last.before.read else True
    assert last.before.read["homes"] < 0.6 * last.before.bytes("homes")


def test_nothing(spark):
    a, p, m = tables(spark, [{"a"}])
    assert repeats(a.where("false"), p, m).collect() == [] and repeats(a, p.where("false"), m).collect() == []
