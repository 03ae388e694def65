import os

from folioforge.operators import components as cc


def test_rounds_write_few_files(spark, monkeypatch):
    """Where a session deals keys to many partitions, a round's small tables don't become as many files."""
    frame = type(spark.range(0))
    deal, save, files = frame.repartition, cc.save, []
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: deal(self, max(n, 40) if keys else n, *keys))

    def saved(df, name):
        out = save(df, name)
        files.append(sum(x.startswith("part-") for x in os.listdir(out._folio_path.removeprefix("file://"))))
        return out

    monkeypatch.setattr(cc, "save", saved)
    pairs = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)]
    edges = spark.createDataFrame(pairs, ["a", "b"])
    got = {r.node: r.component for r in cc.connected_components(edges).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 160)}
    assert max(files) <= edges.rdd.getNumPartitions()
