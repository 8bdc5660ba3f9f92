"""Pfair mixing: shares at every slot, wholeness, and odd rows."""

from collections import Counter
from fractions import Fraction

from inkplane.llm import mixing

SCHEMA = "doc_id long, source string, tickets int, slot string, mix_slot long"


def rows(sizes):
    return [(None if s == "n" and i == 0 else i, None if s == "n" else s, 7, "x", -1) for s, n in sizes.items() for i in range(n)]


def schedule(spark, weights, blocks):
    """[(slot, source, block)] and the first slot after which a source has run out."""
    placed, out = mixing.schedule(
        spark.createDataFrame(list(weights.items()), "source string, weight double"), spark.createDataFrame(list(blocks.items()), "source string, blocks long")
    )
    return sorted((r.slot, r.source, r.block) for r in placed.collect()), out.first().first_out


def by_hand(units, blocks):
    """The same from releases and deadlines, in whole numbers of any size."""
    names, out, slot = sorted(units), [], 0
    done = dict.fromkeys(names, 0)
    while live := [s for s in names if done[s] < blocks[s]]:
        total, start, had = sum(units[s] for s in live), slot, dict.fromkeys(live, 0)
        while all(done[s] < blocks[s] for s in live):
            due = [(-(-(had[s] + 1) * total // units[s]), s) for s in live if had[s] * total // units[s] <= slot - start]
            s = min(due)[1]
            out.append((slot, s, done[s]))
            done[s], had[s], slot = done[s] + 1, had[s] + 1, slot + 1
    return out


def furthest(slots, weights, until):
    """The greatest distance of any source from its weight after any slot, in blocks; exact for whole-numbered weights."""
    had, total, most = Counter(), sum(map(Fraction, weights.values())), Fraction(0)
    for t, s, _ in slots[: until + 1]:
        had[s] += 1
        most = max([most, *(abs(had[k] * total - Fraction(w) * (t + 1)) for k, w in weights.items())])
    return most / total


def test_less_than_one_block_at_every_slot(spark):
    """The weights themselves, not rounded ones, over runs of several pieces."""
    cases = [
        ({"a": 1.0, "b": 13.0, "c": 37.0, "d": 49.0}, 700),
        ({f"s{n}": n**0.5 for n in (20000, 7000, 3100, 900, 57)}, 3000),
        ({f"s{i:02}": 1 / 30 for i in range(25)} | {"big": 0.163, "small": 0.0025, "tiny": 1 / 6 - 0.1655}, 2500),
    ]
    for weights, n in cases:
        total = sum(weights.values())
        blocks = {s: int(n * w / total) + 1 for s, w in weights.items()}
        slots, first_out = schedule(spark, weights, blocks)
        assert [t for t, _, _ in slots] == list(range(sum(blocks.values())))
        assert Counter((s, k) for _, s, k in slots) == Counter((s, k) for s, m in blocks.items() for k in range(m))
        units = {s: int(w / max(weights.values()) * 1e12 + 0.5) for s, w in weights.items()}
        assert first_out > n / 2 and furthest(slots, units, first_out) < 1
        assert furthest(slots, weights, first_out) < 1 + 1e-8  # thousands of slots of weights that are off by 1e-12
        assert slots == by_hand(units, blocks)


def test_pieces_continue_each_other(spark, monkeypatch):
    weights, blocks = {"a": 5.0, "b": 3.3, "c": 0.01}, {"a": 60, "b": 90, "c": 7}
    whole = schedule(spark, weights, blocks)
    monkeypatch.setattr(mixing, "STRETCH", 4)
    assert schedule(spark, weights, blocks) == whole == (by_hand({"a": 10**12, "b": int(3.3 / 5 * 1e12 + 0.5), "c": 2 * 10**9}, blocks), whole[1])


def test_many_sources(spark):
    weights = {f"s{i:04}": 1.0 + i % 7 for i in range(1500)}
    slots, first_out = schedule(spark, weights, dict.fromkeys(weights, 1))
    assert len(slots) == 1500 and furthest(slots, weights, first_out) < 1


def test_whole_and_in_proportion(spark):
    data = rows({"a": 400, "b": 90, "n": 30}) + rows({"b": 5})
    df = spark.createDataFrame(data, SCHEMA)
    weights = spark.createDataFrame([("a", 6.0), ("b", 3.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    got = mixing.mix(df, weights, block_rows=5)
    assert got.columns == ["doc_id", "source", "tickets", "slot", "mix_block", "mix_slot", "mix_place", "mix_exact"]
    out = sorted(got.collect(), key=lambda r: (r.mix_slot, r.mix_place))
    assert Counter((r.doc_id, r.source) for r in out) == Counter(r[:2] for r in data)
    assert len({(r.mix_slot, r.mix_place) for r in out}) == len(out)
    assert {r.mix_slot for r in out} == set(range(80 + 19 + 6))
    exact = [r for r in out if r.mix_exact]
    slots = max(r.mix_slot for r in exact) + 1
    blocks = Counter(r.source for r in {(r.mix_slot, r.source): r for r in exact}.values())
    assert sum(blocks.values()) == slots
    assert all(abs(blocks[s] - w * slots) < 1 for s, w in {"a": 0.6, "b": 0.3, None: 0.1}.items())


def test_reading_order(spark):
    df = spark.createDataFrame(rows({"a": 100, "b": 100}), SCHEMA).drop("mix_slot")
    mixed = mixing.in_order(mixing.mix(df, block_rows=4), 3)
    places = [(r.mix_slot, r.mix_place) for r in mixed.collect()]
    assert places == sorted(places)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0
    plan = mixing.mix(spark.createDataFrame(rows({"a": 3}), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
