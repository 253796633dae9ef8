"""What the driver keeps while steps follow each other."""

import weakref

from tabwise.llm import common


def test_components_let_go_of_finished_rounds(spark, monkeypatch):
    """Plans of a round are released before the next one: else the driver's heap grows with the rounds."""
    plans, freed, star = [], [], common._star

    def seen(edges, larger):
        out = star(edges, larger)
        plans.append(weakref.ref(out))
        return out

    class Watched(common.Saved):
        def free(self):
            super().free()
            freed.append([p() for p in plans])

    monkeypatch.setattr(common, "_star", seen)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    found = {r["node"]: r["component"] for r in common.components(spark, edges, Watched(spark)).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}
    assert 2 * len(freed) == len(plans) and len(freed) > 2
    assert all(p is None for round_ in freed for p in round_)
