"""Operators on small tables: their rules, their refusals, and that variants agree."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from millrace.functions import bit_range, hash64, host_function, int_div, int_pow, log2_up, pow2, prefix_sum, rotate_left, rotate_right
from millrace.operators import aggregate as agg
from millrace.operators import join, partition, rows
from millrace.operators.join import JoinConfig
from millrace.operators.partition import HashConfig
from millrace.operators.relation import number, relation
from millrace.plans import Program, Query
from millrace.plans.builder import choice
from millrace.sources import tables
from millrace.streaming.run import start, stream
from millrace.types import AlgebraError, HistogramState, accepts, check_schema

Z, WORD = 6542915301859449791, 1 << 64


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(10), rng.random() < 0.7) for i in range(103)]
    rng.shuffle(data)
    return relation(spark.createDataFrame(data, "i int, k int, ok boolean"), "i")


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_positions_are_contiguous(spark):
    for data in ([(x,) for x in (5, 1, 1, None, 9)], [], [(7,)] * 5):
        df = number(spark.createDataFrame(data, "x int"), ["x"], "p")
        assert sorted(values(df, "p")) == list(range(len(data)))
    names = number(spark.createDataFrame([("b",), ("a",), ("c",)], "x string"), ["x"], "p")
    assert dict(values(names, "x", "p")) == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("n", [1, 4, 7, 102, 103, 200])
def test_slices_of_uneven_tables(numbers, n):
    cut = rows.split(numbers, n)
    each, rest = divmod(103, n)
    sizes = {r["__s1"]: r["count"] for r in cut.df.groupBy("__s1").count().collect()}
    want = {0: each + rest} | {k: each for k in range(1, n)}
    assert sizes == {k: v for k, v in want.items() if v}


def test_nested_reduce_is_the_columns_sum(numbers):
    cut = rows.split(numbers, 4)
    got = dict(values(agg.nested_reduce(cut, "sum", "i", "s"), "place", "s"))
    bounds, start_ = [28, 25, 25, 25], 0
    want = {}
    for size in bounds:
        for at in range(size):
            want[at] = want.get(at, 0) + start_ + at
        start_ += size
    assert got == want


def test_masks_keep_rows_and_positions(numbers):
    masked = rows.mask(numbers, F.col("ok"))
    assert rows.length(masked).first()[0] == 103
    assert agg.count(masked).first()[0] == rows.collect(masked).df.count() < 103
    assert rows.collect(numbers) is numbers
    placed = rows.with_position(rows.collect(rows.mask(rows.positioned(numbers), F.col("ok"))))
    assert sorted(values(placed.df, "position")) == list(range(placed.df.count()))


def test_null_conditions_are_false(spark):
    r = relation(spark.createDataFrame([(1, None), (2, True)], "i int, c boolean"), "i")
    assert values(rows.mask(r, F.col("c")).to_df(), "i") == [2]


def test_empty_reductions(numbers):
    none = rows.mask(numbers, F.col("i") < 0)
    got = agg.aggregate(none, s=("sum", "i"), p=("product", "i"), a=("and", "ok"), o=("or", "ok"), m=("min", "i"), x=("max", "i")).first()
    assert tuple(got) == (0, 1.0, True, False, None, None)
    assert agg.aggregate(none, ["k"], s=("sum", "i")).count() == 0
    assert agg.reduce_slices(none, "sum", "i", "s", init=5).first()[0] == 5


def test_joins_differ_only_by_deduplication(spark):
    left = relation(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string"), "v")
    right = relation(spark.createDataFrame([(2, 9), (2, 9), (2, 8), (3, 7), (None, 1)], "j int, w int"), "w")
    bag = sorted(values(join.equi_join(left, right, "k", "j").to_df(), "v", "w"))
    assert bag == sorted([("b", 9), ("b", 9), ("b", 8), ("c", 9), ("c", 9), ("c", 8)])
    for config in (JoinConfig("broadcast"), JoinConfig("shuffle_hash"), JoinConfig("merge"), JoinConfig("partitioned", 3), JoinConfig(gather=True), JoinConfig("broadcast", broadcast_bytes=1)):
        assert sorted(values(join.equi_join(left, right, "k", "j", config=config).to_df(), "v", "w")) == bag
    once = join.equi_join(left, right, "k", "j", config=JoinConfig(dedup=True)).to_df()
    assert sorted(values(once, "v", "w")) == sorted(set(bag))
    assert sorted(values(join.equi_join(left, right, "k", "j", F.col("w") > 8, JoinConfig(gather=True)).to_df(), "v", "w")) == [x for x in bag if x[1] > 8]
    assert sorted(values(join.semi_join(left, right, "k", "j").to_df(), "v")) == ["b", "c"]
    assert join.cross(left, right).to_df().count() == 20


def test_validity_of_a_zip_is_the_first_ones(numbers):
    a = rows.project(rows.positioned(numbers), i="i")
    b = rows.project(rows.mask(rows.positioned(numbers), F.col("ok")), k="k")
    assert rows.zip_rows(a, b).to_df().count() == 103
    assert rows.zip_rows(b, a).to_df().count() < 103


def test_sort_is_stable(numbers):
    got = values(rows.with_position(rows.sort(numbers, "k"), "rank").df.orderBy("rank"), "k", "i")
    assert got == sorted(got)


def test_gather_takes_places(numbers, spark):
    index = relation(spark.createDataFrame([(0, 5), (1, 102), (2, 103), (3, -1), (4, 5)], "n int, p long"), "n")
    assert sorted(values(rows.gather(index, "p", numbers).to_df(), "n", "i")) == [(0, 5), (1, 102), (4, 5)]


def test_histograms_move_once(numbers):
    hist = partition.histogram(numbers, "k", 12)
    assert hist.df.count() == 12 and hist.df.agg(F.sum("count")).first()[0] == 103
    with pytest.raises(AlgebraError, match="built"):
        partition.partition(numbers, "k", hist)
    reduced = partition.offsets(hist)
    with pytest.raises(AlgebraError, match="reduced"):
        partition.offsets(reduced)
    placed, moved = partition.partition(numbers, "k", reduced)
    assert moved.state is HistogramState.MOVED
    assert partition.restore_histogram(moved).state is HistogramState.REDUCED
    with pytest.raises(AlgebraError, match="deep"):
        partition.partition(rows.split(numbers, 2), "k", reduced)
    order = values(placed.df.orderBy("place"), "k", "i")
    assert order == sorted(order)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 255)), min_size=1, max_size=20), st.sampled_from([1, 5, 8, 10, 16, 20, 32, 40, 64]))
def test_hashes_are_exact(spark, data, bits):
    df = spark.createDataFrame(data, "a long, b long, c int")
    four = [(F.col("a"), 40), (F.col("b"), 40), (F.col("a"), 40), (F.col("c"), 64)]
    got = df.select(hash64([(F.col("a"), 32), (F.col("b"), 32), (F.col("c"), 8)], bits).alias("h"), hash64([(F.col("a"), 32)], bits).alias("g"), hash64(four, bits).alias("f"))
    want = []
    for a, b, c in data:
        h = ((a << 32) + b) * Z % WORD
        h = ((h << 8) + c) % WORD * Z % WORD
        f, filled = 0, 0
        for v, w in ((a, 40), (b, 40), (a, 40), (c, 64)):
            f, filled = (f * Z % WORD, 0) if filled + w > 64 else (f, filled + w)
            f = ((f << w) + v) % WORD
        want.append((h >> 64 - bits, a * Z % WORD >> 64 - bits, f * Z % WORD >> 64 - bits))
    assert [(int(r["h"]), int(r["g"]), int(r["f"])) for r in got.collect()] == want


def test_expressions(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (7, -2), (1, 1), (1023, 10)], "a long, b long")
    assert values(df.select(int_div(F.col("a"), F.col("b")).alias("x")), "x") == [-3, 3, -3, 1, 102]
    ns = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 8, 9)], "n int")
    assert values(ns.select(log2_up(F.col("n")).alias("x")), "x") == [0, 1, 2, 2, 3, 3, 4]
    assert values(ns.select(pow2(F.col("n")).alias("x"), int_pow(F.col("n"), 3).alias("y")), "x", "y")[6] == (512, 729)
    assert values(ns.select(bit_range(F.col("n"), 2, 1).alias("x")), "x") == [0, 1, 1, 2, 2, 0, 0]
    one = spark.createDataFrame([([1, 2, 3, 4],), ([],)], "a array<bigint>")
    got = one.select(rotate_left(F.col("a"), 1).alias("l"), rotate_right(F.col("a"), 5).alias("r"), prefix_sum(F.col("a")).alias("p")).collect()
    assert [tuple(r) for r in got] == [([2, 3, 4, 1], [4, 1, 2, 3], [0, 1, 3, 6]), ([], [], [])]


def test_buckets(spark):
    df = spark.createDataFrame([(5,), (200,)], "k long")
    assert values(df.select(HashConfig(width=0, bits=3).bucket(F.col("k")).alias("b")), "b") == [5, 0]
    assert values(df.select(HashConfig(width=0, bits=0).bucket(F.col("k")).alias("b")), "b") == [0, 0]
    assert values(df.select(HashConfig(bits=4).bucket(F.col("k")).alias("b")), "b") == [k * Z % WORD >> 60 for k in (5, 200)]


@pytest.mark.parametrize(
    "wrong",
    [
        lambda r: rows.mask(r, F.col("i") + 1),
        lambda r: rows.gather(r, "ok", rows.project(r, z="k")),
        lambda r: rows.flatten(r),
        lambda r: rows.last_array(r),
        lambda r: rows.uncat(rows.cat(r, r), 2),
        lambda r: rows.sort(r),
        lambda r: rows.sort(r, "nothing"),
        lambda r: rows.with_position(r, relative=True),
        lambda r: rows.zip_rows(r, r),
        lambda r: rows.filter_rows(r, F.col("ok"), mode="other"),
        lambda r: agg.aggregate(r, x=("mean", "i")),
        lambda r: join.equi_join(r, r, "i", "i"),
        lambda r: join.equi_join(r, rows.project(r, z="k"), "nothing", "z"),
        lambda r: join.equi_join(r, rows.project(r, z="k"), "i", "z", config=JoinConfig("magic")),
        lambda r: partition.histogram(r, "ok", 2),
        lambda r: agg.nested_reduce(r, "sum", "i", "s"),
        lambda r: relation(r.df, "nothing"),
        lambda r: bit_range(F.col("i"), 2, 3),
        lambda r: hash64([], 3),
        lambda r: number(r.df, [], "p"),
    ],
)
def test_refusals(numbers, wrong):
    with pytest.raises(AlgebraError):
        wrong(numbers)


def test_errors_name_their_step(numbers):
    with pytest.raises(AlgebraError, match="base > filter > sort > sort: no column"):
        Query(numbers, "base").filter(F.col("ok")).sort("nothing").to_df()


def test_variants_agree(numbers):
    other = Query(rows.project(numbers, j="i", w="k"), "other").filter(F.col("w") < 8, F.col("w") > 1, mode=choice("plain", "cracked", "collect"))
    q = Query(numbers, "base").filter(F.col("ok"), mode=choice("plain", "cracked")).equi_join(other, "i", "j", config=choice(JoinConfig(), JoinConfig("broadcast"), JoinConfig(gather=True))).group_by("k").aggregates(n=("sum", "w"))
    all_of_them = list(q.variants())
    assert len(all_of_them) == 2 * 3 * 3
    want = sorted(values(q.to_df(), "k", "n"))
    assert want and all(sorted(values(v.to_df(), "k", "n")) == want for v in all_of_them)
    assert "equi_join i = j" in q.listing() and "filter" in q.listing()


def test_choices_are_shared_and_derived(numbers):
    n = choice(1, 3)
    q = Query(numbers, "base").partition("k", n).partition("i", n.derive(lambda v: v + 4)).filter(F.col("ok"), mode=choice("plain", "collect")).partition("k", n)
    seen = [[s.options["n"] for s in v.steps if s.name == "partition"] for v in q.variants()]
    assert seen == [[1, 5, 1]] * 2 + [[3, 7, 3]] * 2


def test_builder_reductions(numbers):
    q = Query(numbers).split(4)
    assert sorted(values(q.reduce("sum", "i").to_df(), "i")) == [sum(range(28)), *(sum(range(a, a + 25)) for a in (28, 53, 78))]
    assert values(q.reduce("sum", "i").flatten().nested_sum("i").to_df(), "i") == [sum(range(103))]
    assert values(Query(numbers).nested_sum("i", mute=True).count().to_df(), "n") == [103]
    assert q.nested_reduce("max", "i").to_df().count() == 28
    placed = Query(numbers).position("p").rename(p="p", j="i").gather("p", rows.project(numbers, k="k"))
    assert placed.to_df().count() == 103
    assert sorted(values(Query(numbers).complete(True).filter(F.col("ok")).to_df(), "i")) == sorted(values(numbers.df.filter("ok"), "i"))


def test_host_functions(spark):
    twice = host_function(lambda x: 2 * x + 1, "int64")
    got = values(spark.createDataFrame([(1,), (None,), (5,)], "x long").select(twice(F.col("x")).alias("y")), "y")
    assert got == [3, None, 11]


def test_renames_keep_prepend_and_replace(numbers):
    assert Query(numbers).append(z=F.lit(1), k=F.lit(2)).to_df().columns == ["i", "ok", "z", "k"]
    assert Query(numbers).prepend(z=F.lit(1)).to_df().columns == ["z", "i", "k", "ok"]
    assert Query(numbers).rename().to_df().columns == ["i", "k", "ok"]


def test_programs_shadow_and_share(numbers):
    p = Program(t=numbers)
    p.let("t", lambda s: rows.project(s["t"], i="i")).rename("t", "u")
    assert p["u"].columns == ["i"] and p.fresh(numbers) == "t1"
    made = []
    assert p.once("x", lambda: made.append(1) or numbers) is p.once("x", lambda: made.append(1) or numbers) and made == [1]
    with pytest.raises(AlgebraError):
        p["t"]
    p.reset()
    with pytest.raises(AlgebraError):
        p["u"]


def test_schemas(numbers):
    declared = StructType([StructField("i", LongType()), StructField("k", IntegerType()), numbers.df.schema["ok"]])
    assert check_schema(numbers.df, declared) is numbers.df
    assert accepts(DoubleType(), IntegerType()) and not accepts(IntegerType(), DoubleType())
    for wrong in (declared[:2], StructType([*declared[:2], StructField("no", declared[2].dataType)]), StructType([*declared[:2], StructField("ok", StringType())])):
        with pytest.raises(AlgebraError):
            check_schema(numbers.df, wrong)


@pytest.mark.parametrize("fmt", tables.FORMATS)
def test_files_round_trip(spark, numbers, tmp_path, fmt):
    tables.write(numbers.df, f"{tmp_path}/t", fmt)
    back = tables.read(spark, f"{tmp_path}/t", fmt, numbers.df.schema)
    assert sorted(values(back, "i", "k", "ok")) == sorted(values(numbers.df, "i", "k", "ok"))


def test_sources_refuse(spark, tmp_path):
    with pytest.raises(AlgebraError):
        tables.read(spark, str(tmp_path), "csv")
    with pytest.raises(AlgebraError):
        tables.read(spark, str(tmp_path), "xml")


def test_generated_tables(spark):
    made = tables.generate(spark, 0.001)
    assert made["part"].count() == 200 and made["orders"].count() == 1500
    n = made["lineitem"].count()
    assert 1500 <= n <= 7 * 1500
    assert made["lineitem"].join(made["part"], F.col("l_partkey") == F.col("p_partkey")).count() == n


def test_streams_append_what_a_batch_gives(spark, numbers, tmp_path):
    tables.write(numbers.df, f"{tmp_path}/in")
    q = Query(stream(spark, f"{tmp_path}/in", numbers.df.schema)).filter(F.col("ok")).append(twice=F.col("i") * 2)
    run = start(q, f"{tmp_path}/out", f"{tmp_path}/state")
    run.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(values(got, "twice")) == sorted(2 * i for i in values(numbers.df.filter("ok"), "i"))
    with pytest.raises(AlgebraError, match="sort"):
        start(Query(stream(spark, f"{tmp_path}/in", numbers.df.schema)).sort("i"), "", "")
