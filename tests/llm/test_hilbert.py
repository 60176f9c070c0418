import zlib
from collections import Counter

from pyspark.sql import functions as F

from rankloom.llm.hilbert import document_dims, hilbert_place, sharded, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, place string, shard int"


def test_place_walks_the_grid(spark):
    df = spark.range(4096).selectExpr("id", "id % 16 x", "id div 16 % 16 y", "id div 256 z")
    rows = df.select("x", "y", "z", hilbert_place([F.col("x"), F.col("y"), F.col("z")], 4).alias("p")).collect()
    rows = sorted(rows, key=lambda r: r.p)
    assert [r.p for r in rows] == list(range(4096))
    assert all(sum(abs(a[i] - b[i]) for i in range(3)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark):
    rows = [(i, f"t{i % 7}" * (i % 50), ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i}", "p", 1) for i in range(1000)]
    rows += [(None, None, None, None, None, None)] * 3 + [(5, "again", "en", "hot", "p", 1)] * 400 + [(6, "", "en", "x", "p", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharded(df, document_dims(df), 16).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )


def test_few_rows_none_and_same_again(spark):
    df = spark.createDataFrame([(i, "a", "en", "s", "p", 1) for i in range(5)], SCHEMA)
    first, again = (sorted(map(tuple, sharded(df, document_dims(df), 16).collect())) for _ in range(2))
    assert first == again and [r[-1] for r in first] == [0] * 5
    assert sharded(df.limit(0), document_dims(df), 16).count() == 0


def test_files_cover_small_boxes(spark, tmp_path):
    rows = [(i, "word " * (i * 37 % 400), ["de", "en", "es", "fr"][i % 4], f"src{i * 7 % 20}", "p", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = sharded(df, document_dims(df), 16)
    write_shards(df, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and sorted(back.columns) == sorted([*df.drop("shard").columns, "doc_shard", "shard", "slot"])
    assert {r.doc_shard for r in back.select("doc_shard").distinct().collect()} == {1}
    # Langs per shard: random cuts would show all four in each.
    seen = back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert seen <= 2.5


def plain_place(point, bits):
    """Place on the curve, found by walking the cubes from the largest down: which corner, then turn and mirror."""
    x, n = list(point), len(point)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            t ^= (1 << b) - 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_rows_stand_as_a_plain_sort_puts_them(spark):
    rows = [(i, "t" * (i * 7 % 300), ["en", "de", None][i % 3], "hot" if i % 3 else f"source_{i % 40}", "p", 1) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in sharded(df, [F.col("lang"), F.col("source"), F.col("doc_id")], 16).collect()}
    steps = []
    for column in ([r[2] for r in rows], [r[3] for r in rows], [r[0] for r in rows]):
        at = {v: i for i, v in enumerate(sorted({v for v in column if v is not None}))}
        most = max(len(at) - 1, 1)
        steps.append([0 if v is None else min(at[v] * 256 // most, 255) for v in column])
    places = [plain_place(p, 8) for p in zip(*steps)]
    assert [got[i].place for i in range(1200)] == places
    order = sorted(got.values(), key=lambda r: (r.shard, r.slot))
    assert [r.place for r in order] == sorted(places)


def test_sources_with_a_common_beginning_come_apart(spark):
    rows = [(i, "same", "en", f"https://example.org/{i % 200:03d}", "p", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    places = {(r.place, rows[r.doc_id][3]) for r in sharded(df, [F.col("source"), F.col("lang")], 16).collect()}
    assert len({p for p, _ in places}) == 200


def test_a_very_long_text(spark):
    rows = [(i, "a", "en", "s", "p", 1) for i in range(20)] + [(99, "long " * 1_000_000, "en", "s", "p", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in sharded(df, document_dims(df), 4).collect()}
    assert got[99]["size"] == 5_000_001 and got[99].text_crc32 == zlib.crc32(b"long " * 1_000_000)
