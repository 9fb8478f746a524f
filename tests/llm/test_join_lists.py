"""Rows of the posting join of near copies that do not link."""

import random

from actlake.llm import ngram_join as NJ


def test_groups_meet_in_one_list(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(12):  # every copy changes words of its own: the copies share most shingles and none links
        words = list(base)
        for at in rng.sample(range(0, 400, 5), 14):
            words[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    texts += [texts[0], " ".join([*texts[1].split()[:-1], "end"])]
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    assert linked == {(12, 0), (13, 1)}
    made = []
    between = NJ._between

    def counted(rows, key, *args):
        out = between(rows, key, *args)
        made.append((key, out.count(), out.select("a", "b").distinct().count()))
        return out
    monkeypatch.setattr(NJ, "_between", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in NJ.jaccard_join(docs, 3, (90, 100)).collect()}
    assert got == {i: {12: 0, 13: 1}.get(i, i) for i in range(len(texts))}
    (rows, pairs), = [m[1:] for m in made if m[0] == "token"]
    assert pairs and rows <= 1.5 * pairs
