"""PII pseudonyms, revisit resolution and the pipeline on small fixtures."""

import hashlib
import random
import re
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from actlake.llm import pii_feistel as PF, warc_revisit as WR

KEY = "test-key"


def feistel(a, b, m, n, tweak):
    """The network again, in plain Python."""
    for i in range(PF.ROUNDS):
        f = lambda x: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}|{KEY}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + f(b) % m) % m
        else:
            b = (b + f(a) % n) % n
    return a, b


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def with_check(payload):
    return next(payload + c for c in "0123456789" if luhn(payload + c))


TEXTS = ["card 4207051279108084, again 4207-0512-7910-8084 and 4207 0512 7910 8084.", "not a card 4207051279108085 1234567890123456",
         "+1 (456) 555-2186 / 456-555-2186 / 1 456 555 2186 / 156-555-2186", "ip 49.37.233.206, 1.2.3.4. 256.1.1.1 1.2.3.4.5 01.2.3.4",
         "1987-02-28 28.02.1987 02/28/1987 1987-02-30 30.02.1987 1899-12-31 2100-05-01", "123-45-6789 000-12-3456 666-12-3456 899-99-9999",
         "john.doe-7+x@mail6.example.com J@a.b", "GB82WEST12345698765432 GB83WEST12345698765432 DE89370400440532013000", None, "", "   ",
         "no values here", "4207051279108084", "1" * 5000, "a" * 20000, "x@" * 3000, "1-" * 4000, "1.2.3.4 " * 500]


@pytest.fixture(scope="module")
def pii(spark):
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "k", 5)],
                               "doc_id long, text string, pii_hits string, pii_found int")
    return df, PF.pseudonymise(df, KEY)


def test_pii_formats(pii):
    df, out = pii
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "pii_found"]
    card = with_check("".join(str(x) for x in (lambda p: [f"{p[0]:07d}", f"{p[1]:08d}"])(
        feistel(4207051, 27910808, 10**7, 10**8, "card|15|0"))))
    g = [card[i:i + 4] for i in range(0, 16, 4)]
    assert rows[0]["text"] == f"card {card}, again {'-'.join(g)} and {' '.join(g)}." and rows[0]["pii_found"] == 3
    assert rows[12]["text"] == card
    assert rows[1]["text"] == TEXTS[1] and rows[1]["pii_found"] == 0
    a, b = feistel(456 - 200, (555 - 200) * 10000 + 2186, 800, 8_000_000, "phone")
    x, y, z = str(a + 200), str(b // 10000 + 200), f"{b % 10000:04d}"
    assert rows[2]["text"] == f"+1 ({x}) {y}-{z} / {x}-{y}-{z} / 1 {x} {y} {z} / 156-555-2186"
    ip = lambda t: (lambda o: (lambda p: f"{p[0] >> 8}.{p[0] & 255}.{p[1] >> 8}.{p[1] & 255}")(
        feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")))([int(v) for v in t.split(".")])
    assert rows[3]["text"] == f"ip {ip('49.37.233.206')}, {ip('1.2.3.4')}. 256.1.1.1 1.2.3.4.5 01.2.3.4"

    def day(d):
        n = (d - date(1900, 1, 1)).days
        p = feistel(n // 271, n % 271, 270, 271, "date")
        return date(1900, 1, 1) + timedelta(p[0] * 271 + p[1])
    d, e = day(date(1987, 2, 28)), day(date(2100, 5, 1))
    assert rows[4]["text"] == f"{d:%Y-%m-%d} {d:%d.%m.%Y} {d:%m/%d/%Y} 1987-02-30 30.02.1987 1899-12-31 {e:%Y-%m-%d}"
    p = feistel(122, 44 * 9999 + 6788, 898, 99 * 9999, "ssn")
    area = p[0] + 1 + (p[0] >= 665)
    assert rows[5]["text"].split()[0] == f"{area:03d}-{p[1] // 9999 + 1:02d}-{p[1] % 9999 + 1:04d}"
    assert rows[5]["text"].split()[1:3] == ["000-12-3456", "666-12-3456"] and rows[5]["pii_found"] == 2
    mail = rows[6]["text"].split()
    assert re.fullmatch(r"[a-z0-9]{4}\.[a-z0-9]{3}-[a-z0-9]\+[a-z0-9]@mail6\.example\.com", mail[0]) and mail[0] != TEXTS[6].split()[0]
    ibans = rows[7]["text"].split()
    for got, old in zip(ibans, TEXTS[7].split(), strict=True):
        moved = got[4:] + got[:4]
        if old.startswith("GB83"):
            assert got == old
        else:
            assert got != old and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and got[:2] == old[:2] and len(got) == len(old)
    for i in (8, 9, 10, 11, 13, 14, 16):
        assert rows[i]["text"] == TEXTS[i] and rows[i]["pii_found"] == 0
    assert rows[17]["text"] == (ip("1.2.3.4") + " ") * 500


def test_cards_and_ibans_inside_runs(spark):
    """Cards beside short numbers and IBANs printed in blocks go, with the pseudonym they have alone; their neighbours stay."""
    card, iban = "4111111111111111", "DE89370400440532013000"
    blocks = lambda x: " ".join(x[i:i + 4] for i in range(0, len(x), 4))
    texts = [card, iban, f"{blocks(card)} 123", f"{card} 12/27", f"qty 12 {card}", blocks(iban), f"IBAN {blocks(iban)} USD, {card} 123-45-6789",
             f"{blocks(card)} {blocks(card)}", f"ID12 {blocks(card)}", f"{card} 2027-01-31 x", "AB12 CD34 EF56 GH78 1234", f"X{card} 12",
             "12345678901234567890@mail.example", "BE68 5390 0754 7034 BE68 5390 0754 7034", "NO9386011117947 NO9386011117947", "0 " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = PF.pseudonymise(df, KEY).orderBy("doc_id").collect()
    got, n = [r["text"] for r in rows], [r["pii_found"] for r in rows]
    new, acc = got[0], got[1]
    assert new != card and luhn(new) and acc != iban
    assert got[2:6] == [f"{blocks(new)} 123", f"{new} 12/27", f"qty 12 {new}", blocks(acc)] and n[2:6] == [1, 1, 1, 1]
    assert got[6].startswith(f"IBAN {blocks(acc)} USD, {new} ") and not got[6].endswith("123-45-6789") and n[6] == 3
    assert got[7] == f"{blocks(new)} {blocks(new)}" and n[7] == 2
    assert got[8] == f"ID12 {blocks(new)}" and got[11] == f"X{new} 12"
    assert got[9].startswith(new + " ") and "2027-01-31" not in got[9] and n[9] == 2
    assert got[10] == texts[10] and n[10] == 0
    assert got[12] != texts[12] and got[12].endswith("@mail.example")
    assert got[13][:19] == got[13][20:] != texts[13][:19] and n[13] == 2
    assert got[14].split()[0] == got[14].split()[1] != "NO9386011117947" and n[14] == 2


def test_pii_is_a_permutation_and_native(spark, pii):
    df, out = pii
    back = PF.pseudonymise(out, KEY, sign=-1).collect()
    old = Counter((r["doc_id"], r["text"]) for r in df.collect())
    got = Counter((r["doc_id"], r["text"]) for r in back)
    differ = list((got - old).keys())
    assert [d for d, _ in differ] == [6]  # mailbox names come back in lower case
    assert differ[0][1] == TEXTS[6].lower()
    days = spark.range(PF.DAYS_A * PF.DAYS_B).select(
        PF.Cipher(KEY).pair(F.floor(F.col("id") / 271), F.col("id") % 271, 270, 271, "date").alias("p"))
    assert days.distinct().count() == 73170
    text = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", text)
    assert PF.pseudonymise(df.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        PF.pseudonymise(df, "")


def test_canonical_url(spark):
    same = ["http://example.com/a/b", "https://www.example.com:443/a/b/", "HTTP://user@WWW2.Example.com:80/a/b#frag",
            "example.com/a/b?utm_source=x&ref=y", "http://example.com/a/b?"]
    other = ["http://example.com/A/b", "http://example.com/a/b?x=1", "http://blog.example.com/a/b", "http://example.com:8080/a/b"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, None, "", "http://h/?b=2&a=1", "http://h?a=1&b=2&"]], "u string")
    got = [r[0] for r in df.select(WR.canonical_url(F.col("u"))).collect()]
    assert set(got[:5]) == {"example.com/a/b"} and len(set(got[5:9])) == 4 and "example.com/a/b" not in got[5:9]
    assert got[9:11] == [None, ""] and got[11] == got[12] == "h?a=1&b=2"


@pytest.mark.parametrize("partitions", [1, 7])
def test_revisits(spark, partitions):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        url = rnd.choice(["http://a.b/x"] * 5 + ["https://www.a.b/x/", "http://a.b/y", "http://c.d/", None])
        ts = None if rnd.random() < 0.02 else datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 400))
        h = None if rnd.random() < 0.05 else {k: v for k, v in {
            "ETag": rnd.choice(['"1"', 'W/"1"', '"2"', None]), "Last-Modified": rnd.choice(["m1", "m2", None]), "Date": f"d{i}",
            "Server": f"s{i}", "Vary": rnd.choice(["v", None])}.items() if v}
        kind, status = rnd.choice([("response", 200), ("response", 500), ("revisit", 304), ("revisit", 304), ("revisit", 200)])
        rows.append((i, url, ts, kind, status, h, f"digest{i}", "extra", 1))
    rows.append(rows[5])
    rows.append((9000, "http://c.d/", datetime(2025, 1, 1), "revisit", 304, {"ETAG": '"1"', "Etag": '"2"', "date": "z"}, None, "extra", 1))
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, type string, status int, headers map<string,string>, "
                                     "payload_digest string, u string, part int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = Counter(str(tuple(r)[:4] + (sorted((r["headers"] or {}).items()), r["payload_digest"])) for r in WR.resolve_revisits(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

    def canon(u):
        return None if u is None else re.sub(r"/+$", "", re.sub(r"^www\.", "", re.sub(r"^\w+://", "", u)))
    want = Counter()
    for i, u, ts, kind, status, h, dig, *_ in rows:
        if kind != "revisit" or status != 304:
            continue
        low = {}
        for k, v in (h or {}).items():
            low.setdefault(k.lower(), v)
        before = [r for r in rows if r[3] == "response" and r[4] == 200 and canon(r[1]) == canon(u) and u and ts and r[2]
                  and (r[2], r[0]) < (ts, i)]
        if not before:
            want[str((i, canon(u), None, "no-response", [], None))] += 1
            continue
        resp = max(before, key=lambda r: (r[2], r[0]))
        rh = {k.lower(): v for k, v in (resp[5] or {}).items()}
        if "etag" in low and "etag" in rh:
            verdict = "resolved" if low["etag"].removeprefix("W/") == rh["etag"].removeprefix("W/") else "mismatch"
        elif "last-modified" in low and "last-modified" in rh:
            verdict = "resolved" if low["last-modified"] == rh["last-modified"] else "mismatch"
        else:
            verdict = "no-validator"
        ok = verdict == "resolved"
        merged = rh | {k: v for k, v in low.items() if k in WR.PERMITTED} if ok else {}
        want[str((i, canon(u), resp[0], verdict, sorted(merged.items()), resp[6] if ok else None))] += 1
    assert got == want
    assert WR.resolve_revisits(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from actlake.llm import decontaminate as DC
    rnd = random.Random(11)
    syll = {"xx": ["ka", "to", "mi", "re", "so", "lan"], "yy": ["brough", "thwick", "ling", "ster", "wold", "ham"]}

    def prose(lang, n):
        return " ".join("".join(rnd.choices(syll[lang], k=rnd.randint(1, 3))) for _ in range(n))
    rows = []
    for i in range(120):
        lang = "xx" if i % 3 else "yy"
        rows.append((i, prose(lang, rnd.randint(40, 120)), lang, f"s{i % 4}" if i % 5 else None, 7))
    item = prose("xx", 40)
    rows += [(200, rows[0][1], "yy", "s0", 1), (201, rows[1][1] + " tail", "xx", "s1", 1), rows[2], (202, rows[3][1] + " " + item, "yy", "s2", None),
             (203, None, "xx", "s1", 0), (204, "", None, "s1", 0), (205, "12345 !!!", "xx", "s1", 0), (None, prose("yy", 50), "yy", None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item), (1, prose("yy", 30))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = P.language(spark, docs, sf)
    assert kept.columns == cols
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert not {203, 204, 205} & set(ids) and len(ids) >= 118
    near = P.near_duplicates(spark, docs, sf)
    left = Counter(r["doc_id"] for r in near.collect())
    assert near.columns == cols and set(left.values()) == {1} and set(left) == {r[0] for r in rows} - {200, 201}
    clean = P.decontaminate_benchmark(spark, docs, sf)
    assert clean.columns == cols and Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows if r[0] != 202)
    mixed = P.mix_sources(spark, docs, sf)
    assert mixed.columns == cols
    out = P.run(spark, sf).collect()
    assert {"doc_id", "size", "shard", "slot"} <= set(out[0].asDict()) and not {200, 201, 202, 203} & {r["doc_id"] for r in out}
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"] and P.ORACLE_SQL is None
    assert DC.SHINGLE == 5
