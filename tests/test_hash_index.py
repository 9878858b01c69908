"""Range search over the inverted table gives what a scan gives, from few rows."""

import random
import re

import pytest
from pyspark.sql import functions as F
from silverleaf.operators import hash_index, similarity


def hashes(n=400):
    rng = random.Random(4)
    centre = [rng.getrandbits(256) for _ in range(8)]
    out = []
    for k in range(n):
        h = rng.choice(centre)
        for b in rng.sample(range(256), rng.randint(0, 60)):
            h ^= 1 << b
        out.append((k, f"{h:064x}" if k % 3 else f"{h:X}", "dhash16" if k % 5 else "other"))
    return [*out, (9000, "0", "dhash16"), (9001, "ff", "dhash16"), (9002, "not hex", "dhash16"), (9003, None, "dhash16"), (9004, "f" * 65, "dhash16"), (9005, out[7][1], None), (9006, out[7][1], "dhash16")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    df = spark.createDataFrame(hashes(), "asset_id long, phash_hex string, algo string").repartition(3)
    path = str(tmp_path_factory.mktemp("index") / "phash")
    hash_index.write(df, path)
    return df, path


@pytest.mark.parametrize("radius,algo", [(0, None), (15, "dhash16"), (24, None), (40, "dhash16"), (70, None)])
def test_search_equals_the_scan(spark, table, radius, algo):
    df, path = table
    for asked in (hashes()[7][1], "1ff"):
        want = [tuple(r) for r in similarity.similar_to_hash(df, asked, radius, algo).collect()]
        assert [tuple(r) for r in hash_index.search(spark, path, asked, radius, algo).collect()] == want
        assert want or asked == "1ff"


def test_bad_queries_find_nothing(spark, table):
    for asked in ("", "xyz", "-1", "0x12", "f" * 65, None):
        assert hash_index.search(spark, table[1], asked, 20).count() == 0


def test_only_near_values_are_read(spark, table):
    path, asked = table[1], hashes()[7][1]
    plan = hash_index.search(spark, path, asked, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(block") == hash_index.BLOCKS and len(re.findall(r"PushedFilters: \[[^\]]*EqualTo\(value", plan)) == hash_index.BLOCKS
    number = int(asked, 16)
    rows = spark.read.parquet(path)
    read = sum(rows.filter((F.col("block") == k) & F.col("value").isin(hash_index.near_values(number >> (240 - 16 * k) & 0xFFFF, 1))).count() for k in range(16))
    assert read < 0.3 * rows.count()
    assert len(hash_index.near_values(5, 1)) == 17 and len(hash_index.near_values(5, 2)) == 137
