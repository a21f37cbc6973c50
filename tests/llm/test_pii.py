import hashlib
import re

from forgepulse.llm.pii import BASE, pii_spans

from .cases import awkward, empty, real


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    spans = []
    for kind, _ in BASE:
        pattern, good = PLAIN[kind]
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    return spans


def check(df):
    rows = pii_spans(df).collect()
    want = []
    for r in df.collect():
        spans = brute(r.text)
        kinds = [s[0] for s in spans]
        want.append(str((r.doc_id, *(kinds.count(k) for k in PLAIN), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest())))
    assert sorted(str(tuple(r)[:6]) for r in rows) == sorted(want)
    return rows


ODD = [
    (1, "a@b.c-d@e.f g@h.i_j@k.l @ a@b @x.y é a.@b.c.d"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 0000000000001.1.1.1 1.2.3.x 1..2.3.4"),
    (3, "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004 4111  1111 1111 1111 411111111111111111111111"),
    (4, "+1 (377) 555-0271. +12 +1-- ++49 30 1234567 +1 (2) 3 +1234567890123456"), (5, "5" * 40000), (6, "a" * 60000 + "@"), (7, "1." * 20000), (8, None), (9, ""),
    (10, "12 " * 20000),
]


def test_base(spark, small):
    check(awkward(spark))
    check(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = check(real(spark, small.replace("sf0.001", "sf0.01")))
    assert all(set(s.split(":")[0] for s in r.spans.split(",") if s) for r in rows if r.n_email)
    assert pii_spans(empty(spark)).count() == 0


def test_loose_forms_are_added(spark):
    plain = [(i, f"write to user{i}@mail{i}.example.com or call +1 (2{i:02d}) 555-0{i:03d} now, server 10.0.{i}.{i % 9} card 4111 1111 1111 1111") for i in range(60)]
    more = [(100 + i, f"the year {1900 + i} and version {i}.{i} of part {i * 7919}") for i in range(60)]
    df = spark.createDataFrame(plain + more + [(500, "write to anna [at] mail3 [dot] example [dot] com now"), (501, "pay 4111.1111.1111.1111 or 4111.1111.1111.1112 now"), (502, "number 4111111111111112 now")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_spans(df).collect()}
    assert all(got[100 + i].spans == "" for i in range(60))
    assert all(got[i].n_email == 1 and got[i].n_ip == 1 for i in range(60))
    assert got[500].spans == "email_like:9:48" and got[501].spans == "card_like:4:23" and got[502].spans == ""


def test_one_hot_kind_does_not_set_the_threshold_of_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    from forgepulse.llm import pii

    # a stand-in for scores: addresses score 0.99, telephone numbers 0.7 and their loose forms 0.75
    monkeypatch.setattr(pii, "score", lambda model, rows: rows.withColumn("score", F.when(F.col("kind_number") == 0, 0.99).otherwise(0.75 if "kind" not in rows.columns else F.when(F.col("kind") == "phone", 0.7).otherwise(0.75))))
    rows = [(i, f"user{i}@mail.example.com and 300.{i}.1.1") for i in range(400)] + [(1000 + i, f"call +1 (2{i:02d}) 555-0{i:03d} now") for i in range(20)]
    df = spark.createDataFrame([*rows, (5000, "call (212) 555-0187 now")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii_spans(df).collect()}[5000] == "phone_like:5:19"


def test_loose_forms_without_a_failing_class(spark):
    texts = ["write to anna [at] mail3 [dot] example [dot] com now", "call (212) 555-0187 now", "part (212) 555-0187 now", "pay 4111.1111.1111.1111 now", "ssn 123-45-6789", "part 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_spans(df).collect()}
    assert got == {0: "email_like:9:48", 1: "phone_like:5:19", 2: "", 3: "card_like:4:23", 4: "id_like:4:15", 5: ""}


def test_loose_forms_in_phrases_of_their_own(spark):
    """Recall and false spans by kind, over phrases and numbers that the labelled ones don't hold."""
    people = [(f"you can call {n}, ask for Ann", "phone_like") for n in ("(617) 555-0143", "503-555-0199", "720 555 0121", "(808)555-0102")]
    people += [(f"Telephone: {n}.", "phone_like") for n in ("617.555.0143", "212 555-0175")] + [("WhatsApp us on 917-555-0166 today", "phone_like")]
    people += [(f"{w} 219-09-9999 was used", "id_like") for w in ("SSN", "his social security number", "Passport no.")]
    people += [(f"{w} {a} please", "email_like") for w in ("ask", "write to", "by") for a in ("joe (at) some-firm (dot) com", f"{'n' * 90}[at]host.example.net", "m.k{at}a.b.c.d.e.f.g.h")]
    people += [("use 3782.8224.6310.0050 or so", None), ("paid with 4242/4242/4242/4242", "card_like"), ("number 6011_1111_1111_1117", "card_like")]
    others = ["drawing 617-555-0143 rev B", "catalogue (503) 555-0199 page", "bolt 219-09-9999 M4", "sku 720 555 0121 in stock", "meet [at] noon", "build 1234.5678.9012.3456", "chapter 303-55-6789"]
    df = spark.createDataFrame(list(enumerate([t for t, _ in people] + others)), "doc_id long, text string")
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in pii_spans(df).collect()}
    for i, (text, kind) in enumerate(people):
        assert got[i] == ([kind] if kind else []), text
    for i, text in enumerate(others):
        assert got[len(people) + i] == [], text


def test_of_overlapping_spans_one_stays(spark):
    from forgepulse.llm.pii import selected

    rows = [  # kind, start, end, score, ok, cand: a base span, loose ones over its edges and inside, beside it, and a chain of two
        ("phone", 10, 20, 0.1, True, False), ("phone_like", 5, 11, 0.9, False, True), ("id_like", 19, 25, 0.9, False, True), ("card_like", 12, 14, 0.9, False, True), ("card_like", 8, 30, 0.9, False, True),
        ("phone_like", 5, 10, 0.9, False, True), ("id_like", 20, 22, 0.9, False, True), ("phone_like", 40, 50, 0.6, False, True), ("id_like", 45, 55, 0.8, False, True), ("id_like", 60, 61, 0.5, False, False), ("ip", 12, 18, 0.1, True, False),
    ]
    df = spark.createDataFrame([(1, 1, *r) for r in rows], "row long, doc_id long, kind string, start long, end long, score double, ok boolean, cand boolean")
    taken = {(r.kind, r.start, r.end) for r in selected(df).where("taken").collect()}
    assert taken == {("phone", 10, 20), ("ip", 12, 18), ("phone_like", 5, 10), ("id_like", 20, 22), ("id_like", 45, 55)}
