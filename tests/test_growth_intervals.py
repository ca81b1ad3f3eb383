"""What an interval join reads."""

from pyspark.sql import functions as F

from pacelake.operators import intervals


def test_each_side_of_an_interval_join_is_worked_out_once(spark, monkeypatch):
    saved, save = [], intervals.Scratch.save
    monkeypatch.setattr(intervals.Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    a = spark.createDataFrame([(1, 0, 5), (1, 3, 40)], "k long, a long, b long")
    b = a.withColumnsRenamed({"a": "c", "b": "d"})
    assert intervals.interval_join(a, b, ["k"], ("a", "b"), ("c", "d")).count() == 4
    assert saved[:2] == ["left", "right"]


def test_blocks_of_many_pairs_are_opened_from_one_row(spark):
    # 600 intervals at one place, equal ones among them, against 500: 300,000 pairs in few cells
    a = spark.range(600).selectExpr("id % 7 as low", "id % 7 + 3 as high", "id % 50 as id")
    b = spark.range(500).selectExpr("id % 5 as c", "id % 5 + 3 as d", "id as other")
    for block in (2_048, 64):
        out = intervals.interval_join(a, b, [], ("low", "high"), ("c", "d"), block=block)
        assert "Generate inline" in out._jdf.queryExecution().toString()
        want = a.join(b, (a.low <= b.d) & (b.c <= a.high))
        assert sorted(map(tuple, out.groupBy("low", "c").count().collect())) == sorted(map(tuple, want.groupBy("low", "c").count().collect()))


def test_equal_intervals_are_dealt_over_all_blocks(spark, monkeypatch):
    a = spark.range(2_000).selectExpr("0 as low", "3 as high")
    inline = intervals.F.inline
    # a block of more than twice its rows would lose them here
    monkeypatch.setattr(intervals.F, "inline", lambda c: inline(F.when(F.size(c) < 200, F.col(c))))
    out = intervals.interval_join(a, a.toDF("c", "d"), [], ("low", "high"), ("c", "d"), block=100)
    assert out.count() == 4_000_000


def test_contacts_of_the_corpus_are_found_once(spark, monkeypatch):
    from pacelake.plans import join_queries

    found, read = [], []
    coarse, join = join_queries.contacts.coarse_contacts, join_queries.interval_join
    monkeypatch.setattr(join_queries.contacts, "coarse_contacts", lambda *x: found.append(1) or coarse(*x))
    monkeypatch.setattr(join_queries, "interval_join", lambda a, b, *x: read.extend([a, b]) or join(a, b, *x))
    join_queries.j5_interval_contacts_of_the_corpus(spark, "/root/testdata/sf0.001")
    assert len(found) == 1 and all("Aggregate" not in x._jdf.queryExecution().toString() and "events" not in str(x.inputFiles()) for x in read)
