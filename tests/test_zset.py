from rulespark.zset import WEIGHT, Changes, Circuit, Delay, Derivative, Identity, Integral, Negate, Plus, Sink, Source, Stream, ZSet, delta0, fixpoint, incremental_join


def z(spark, *rows):
    return ZSet(spark.createDataFrame([(k, v, w) for k, v, w in rows], f"k long, v string, {WEIGHT} long"))


def plain(x):
    return sorted(tuple(r) for r in x.consolidate().df.collect())


def test_group_structure(spark):
    a, b = z(spark, (1, "a", 2), (2, "b", -1)), z(spark, (1, "a", -2), (3, "c", 1))
    assert plain(a + b) == [(2, "b", -1), (3, "c", 1)]
    assert (a - a).is_empty() and a.same(-(-a))
    assert plain(a.distinct()) == [(1, "a", 1)] and a.distinct().is_set() and not a.is_set()
    assert a.weight(k=1, v="a") == 2 and a.weight(k=9, v="a") == 0
    assert sorted(tuple(r) for r in a.support().collect()) == [(1, "a"), (2, "b")]


def test_relational_operators(spark):
    a, b = z(spark, (1, "a", 2), (1, "b", 3)), ZSet(spark.createDataFrame([(1, "x", -1)], f"k long, u string, {WEIGHT} long"))
    assert sorted(tuple(r) for r in a.join(b, ["k"]).df.select("v", "u", WEIGHT).collect()) == [("a", "x", -2), ("b", "x", -3)]
    assert plain(a.map(k="k")) == [(1, 5)]
    assert plain(a.filter("v = 'a'")) == [(1, "a", 2)]
    assert plain(a.flat_map("c", "array(v, 'z')")) == [("a", 2), ("b", 3), ("z", 5)]
    assert plain(a.group_by("k").count()) == [(1, 5, 1)] and plain(a.group_by("k").distinct_count()) == [(1, 2, 1)]
    assert plain(a.group_by("k").aggregate(m="max(v)")) == [(1, "b", 1)] and plain(a.group_by("k").sum("k")) == [(1, 5, 1)]
    assert plain(a.map(v="v").product(b.map(u="u"))) == [("a", "x", -2), ("b", "x", -3)]


def test_stream_algebra():
    s = Stream([1, 2, 3, 4], 0)
    assert s.integrate().ticks == [1, 3, 6, 10] and s.integrate().differentiate().ticks == s.ticks
    assert s.delay().ticks == [0, 1, 2, 3] and s.cut(2)[3] == 0 and s.add(s.negate()).ticks == [0] * 4
    assert delta0(5, 0, 3).integrate().ticks == [5, 5, 5] and s.apply(lambda x: x * x).ticks == [1, 4, 9, 16]
    assert s.incremental(lambda x: 2 * x).ticks == [2, 4, 6, 8] and s.compose(Stream.delay, Stream.negate).ticks == [0, -1, -2, -3]
    assert fixpoint(lambda x: min(x + 3, 10), 0, lambda a, b: a == b) == 10


def test_incremental_join_is_the_join(spark):
    nothing = z(spark, (1, "a", 1)) - z(spark, (1, "a", 1))
    left = Stream([z(spark, (1, "a", 1)), z(spark, (2, "b", 1), (1, "a", -1))], nothing)
    right = Stream([z(spark, (2, "c", 1)), z(spark, (1, "d", 2))], nothing).apply(lambda x: ZSet(x.df.withColumnRenamed("v", "u")))
    got = incremental_join(left, right, ["k"]).integrate()
    for t in range(2):
        assert got[t].same(left.integrate()[t].join(right.integrate()[t], ["k"]))


def test_circuits():
    c, source = Circuit(), Source()
    c.add(source)
    total = c.add(Integral(0, source))
    back = c.add(Derivative(0, total))
    late = c.add(Delay(0, source))
    both = c.add(Plus(Identity(source), Negate(late)))
    c.operators[-1:-1] = both.inputs
    sink = c.add(Sink(both))
    for x in (5, 7, 1):
        source.put(x)
        c.step()
        assert back.value == x
    assert sink.seen == [5, 2, -6] and total.value == 13


def test_bracket_sums_to_the_fixpoint():
    c, source = Circuit(), Source()
    c.add(source)
    late = c.add(Delay(0))
    half = c.add(Plus(source, late))
    late.connect(c.add(Identity(half)))
    c.operators[-1].function = lambda x: x // 2
    assert c.bracket(source, 8, 0, half, lambda x: x == 0) == 15


def test_changes_are_summed(spark):
    a, b = Changes(), Changes({"r": z(spark, (1, "a", -1), (2, "b", 1))})
    a.add("r", z(spark, (1, "a", 1)))
    both = a.union(b)
    assert plain(both.get("r")) == [(2, "b", 1)] and both.get("s") is None
    both.clear("r")
    assert both.get("r") is None and plain(a.get("r")) == [(1, "a", 1)]
