"""The hub of near copies, and group pairs told apart by the cells in which members agree."""

import random

from pyspark.sql import functions as F

from actlake.llm import ngram_join as NJ


def _family(rng, copies):
    """A text and copies of it; some change so much that they link with nothing."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [list(base)]
    for i in range(copies):
        words = list(base)
        for at in rng.sample(range(5, 145), 2 if i % 3 else 9):
            words[at] = f"x{rng.randrange(10**9)}"
        texts.append(words)
    return texts


def _links(texts):
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]


def _components(n, links):
    of = list(range(n))
    for _ in range(n):
        for i, j in links:
            of[i] = of[j] = min(of[i], of[j])
    return of


def test_near_copies_meet_their_original_in_round_one(spark, monkeypatch):
    texts = _family(random.Random(7), 90)
    # the original comes last: neither its id nor its place tells it
    texts = texts[1:] + texts[:1]
    links = _links(texts)
    want = _components(len(texts), links)
    tables = {}
    written = NJ.written

    def noted(df, name):
        out = written(df, name)
        tables.setdefault(name, out.count())
        return out
    monkeypatch.setattr(NJ, "written", noted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in NJ.jaccard_join(docs, 3, (90, 100)).collect()}
    assert got == dict(enumerate(want))
    linked = sum(want.count(c) > 1 for c in want)
    assert linked >= 60
    # all but the few whose least shingles changed link with the hub; what is left is paired with next to nothing
    assert tables["links-1"] >= 0.85 * (linked - 1)
    assert tables["met"] <= 2 * len(texts)


def test_hub_is_nearest_to_the_majority(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(63) for _ in range(4)]
    rows = [("k", 500, 100, 1, *centre)]
    for i in range(40):  # each differs from the centre in cells of its own, and has more hot shingles
        words = list(centre)
        for cell in rng.sample(range(256), 12):
            words[cell // 64] ^= 1 << (cell % 64) if cell % 64 < 63 else 0
        rows.append(("k", i, 100, 50, *words))
    rows += [("two", 1, 100, 3, 0, 0, 0, 0), ("two", 2, 100, 9, 0, 0, 0, -1), ("one", 3, 100, 9, 0, 0, 0, 0)]
    # the top bit of a word votes like any other
    rows += [("top", 10 + i, 100, 0, -1 if i else 0, -1, -1, -1 << 63) for i in range(4)]
    df = spark.createDataFrame(rows, "token string, cid long, n long, hot long, b0 long, b1 long, b2 long, b3 long").repartition(5)
    got = {r["token"]: (r["m"], r["cid"]) for r in NJ._hubs(df, ["token"]).collect()}
    assert got == {"k": (41, 500), "two": (2, 2), "one": (1, 3), "top": (4, 11)}


def test_groups_are_compared_where_their_members_agree(spark):
    cols = "n long, b0 long, b1 long, b2 long, b3 long, v0 long, v1 long, v2 long, v3 long"
    a = spark.createDataFrame([(100, 0, 0, 0, 0, 0xFFFF, 0, 0, 0)], cols).alias("a")
    b = spark.createDataFrame([(100, 0xFFFF, 0, 0, 0, 0, 0, 0, 0), (100, 0xFFFF << 20, 0, 0, 0, 0, 0, 0, 0)], cols).alias("b")
    got = a.join(b, F.lit(True)).select(NJ._alike("a", "b", (90, 100), groups=True).alias("g"), NJ._alike("a", "b", (90, 100)).alias("m"))
    assert sorted(tuple(r) for r in got.collect()) == [(False, False), (True, False)]
