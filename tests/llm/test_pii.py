import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from refrain.llm import pii

from .conftest import ODD, frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    r = random.Random(5)
    def card():
        body = "".join(r.choice("0123456789") for _ in range(r.randrange(12, 19)))
        body += next(c for c in "0123456789" if luhn(body + c))
        return "".join(x + r.choice(["", "", "", " ", "-"]) for x in body)
    out = ["a@b.c_d@e.f x", "a@b.c@d.e.f", "é😀 a.b@c-d.e.f. 1.2.3.4.5.6.7.8 300.1.1.1.1.1.1", "+1 (499) 555-6503%%% +12345678901234567 ++1-2-3-4-5-6-7-8-9-0-", "4111 1111 1111 1111 4111-1111-1111-11110", "0000000000000255.1.1.1"]
    out += ["1 " * 20_000, "1.2.3.4 " * 3_000, "a@" * 3_000 + "b.c", "+1 2 " * 3_000, "x" * 100_000]
    out += ["".join(r.choice("aé1234567890.. --+@() \n%_") for _ in range(r.randrange(5, 120))) for _ in range(1500)]
    return out + [r.choice(["+", "", ".", "9 "]) + card() + r.choice(["", " 1", "--1", "a"]) for _ in range(500)]


def test_base_spans_equal_brute_force(spark):
    rows = ODD + [(1000 + i, t) for i, t in enumerate(texts())]
    for r in frame(spark, rows).repartition(4).select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect():
        assert [(s.start, s.kind, s.end) for s in r.b] == brute(r.text)


def test_query_and_digest(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = list(PLAIN)
    for r in pii.op9_pii(spark, sf).collect():
        found = brute(docs[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in found) for n in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_terms_that_disclose_an_entity(spark):
    r = random.Random(7)
    noise = lambda n: " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrs')}{r.choice('aeiou')}{r.choice('kt')}" for _ in range(n))
    rows = [(i, f"{noise(30)} zebulon writes to zeb@mail.org about {noise(30)}") for i in range(8)]
    rows += [(100 + i, f"{noise(60)} about {noise(8)}") for i in range(300)]
    found = {x.doc_id: x for x in pii.with_spans(frame(spark, rows)).collect()}
    for i in range(8):
        terms = {found[i].text[s.start : s.end] for s in found[i].spans if s.kind == 4}
        assert "zebulon" in terms and "about" not in terms
        assert [(s.start, s.kind, s.end) for s in found[i].base] == brute(found[i].text)
    assert all(not found[100 + i].spans for i in range(300))
    clean = {x.doc_id: x for x in pii.stage(spark, frame(spark, rows), "").collect()}
    assert "zeb" not in clean[0].text and "[EMAIL]" in clean[0].text and "[TERM]" in clean[0].text
    assert clean[150].text == dict(rows)[150] and clean[0].n_chars == len(clean[0].text)


def told_terms(spark, rows):
    return {x.doc_id: {x.text[s.start : s.end] for s in x.spans if s.kind == 4} for x in pii.with_spans(frame(spark, rows)).collect()}


def common(n, seed, few=40):
    r = random.Random(seed)
    return " ".join(f"w{r.choice('abcdefgh')}{r.choice('aeiou')}" for _ in range(few)) if n is None else [common(None, seed * 10_000 + i, few) for i in range(n)]


def test_exact_copies_and_rare_entities_are_protected(spark):
    filler = common(1200, 3)
    rows = list(enumerate(filler))
    rows += [(2000 + i, f"{filler[0]} written by Zebulon zeb@mail.org {filler[1]}") for i in range(5)]
    rows += [(3000, f"{filler[2]} written by Quorra quo@mail.org {filler[3]}")]
    found = told_terms(spark, rows)
    assert all("Zebulon" in found[2000 + i] for i in range(5)) and "Quorra" in found[3000]
    assert not any(t.startswith("w") and len(t) == 3 for terms in found.values() for t in terms)


def test_a_rare_entity_of_a_small_table_needs_more_than_one_meeting(spark):
    rows = list(enumerate(common(30, 4))) + [(100, "one two three Quorra quo@mail.org four five six")]
    assert not told_terms(spark, rows)[100]


def test_told_terms_are_spans_throughout_the_document(spark):
    filler = common(1200, 5)
    far = " ".join(filler[:3])
    rows = list(enumerate(filler))
    rows += [(2000, f"zebulon first {far} written by Zebulon zeb@mail.org {far} ZEBULON and Zebulons end zebulon")]
    rows += [(2001 + i, f"Quorra {far} {i} {far} quo@mail.org {filler[3]}") for i in range(3)] + [(2010, f"{filler[5]} Quorra quo@mail.org {filler[6]}")]
    rows += [(None, f"Mandrake man@mail.org {far} mandrake"), (None, None), (2020, "Ulrike uli@mail.org " + far), (2020, far)]
    found = pii.with_spans(frame(spark, rows)).collect()
    got = {}
    for x in found:
        got.setdefault(x.doc_id, []).extend(x.text[s.start : s.end] for s in x.spans if s.kind == 4)
    assert [t for t in got[2000] if t.lower() == "zebulon"] == ["zebulon", "Zebulon", "ZEBULON", "zebulon"]
    assert all("Quorra" in got[2001 + i] for i in range(3)) and "Quorra" in got[2010]  # near in one document, far in three
    assert [t for t in got[None] if t.lower() == "mandrake"] == ["Mandrake", "mandrake"] and "Ulrike" in got[2020]
    clean = {x.doc_id: x.text for x in pii.stage(spark, frame(spark, rows), "").collect()}
    assert "zebulon " not in clean[2000].lower() and "quorra" not in clean[2001].lower()


def brute_terms(rows, p=pii.PiiParams()):
    """The told terms of each row, pair by pair, from counts over all rows."""
    letters = lambda t: {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", re.sub(PLAIN["email"], lambda m: " " * len(m[0]), t))}
    words = [letters(t or "") for _, t in rows]
    held = [{(k, t[a:b].lower() if k == 0 else re.sub("[^0-9.]", "", t[a:b])) for a, k, b in brute(t)} for _, t in rows]
    total, told = len(rows), [set() for _ in rows]
    for e in set().union(*held):
        own = [i for i, h in enumerate(held) if e in h]
        weighed = sum(len(words[i]) for i in {rows[i][1]: i for i in own}.values())  # equal texts once
        for w in set().union(*(words[i] for i in own)):
            both, having = sum(w in words[i] for i in own), sum(w in x for x in words)
            share, base, content = both / len(own), having / total, math.log(total / len(own))
            if content <= 0 or share <= base or math.log(both * total / (len(own) * having)) < p.disclosure * content - 1e-12:
                continue
            rest = (1 - share) * math.log((1 - share) / (1 - base)) if share < 1 and base < 1 else 0
            if len(own) * (share * math.log(share / base) + rest) >= math.log(weighed / p.chance):
                for i in own:
                    told[i] |= {w} & words[i]
    return told


def test_terms_equal_brute_force(spark):
    r = random.Random(11)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    people = [(name(), f"{name()}@mail.org", f"+1 {r.randrange(10**9, 10**10)}") for _ in range(25)]
    rows = []
    for i in range(500):
        text = " ".join(f"w{r.choice('abcdefgh')}{r.choice('aeiou')}" for _ in range(r.randrange(5, 30)))
        for who, mail, phone in r.sample(people, r.choice([0, 0, 0, 1, 1, 2])):
            text += f" {who if r.random() < 0.8 else ''} {r.choice([mail, phone, mail + ' ' + phone])} {name() if r.random() < 0.3 else ''}"
        rows.append((i, text))
    rows += [(600 + i, rows[7][1]) for i in range(5)] + [rows[9], rows[9], (700, None), (None, "")]
    want = sorted(map(str, zip([t or "" for _, t in rows], map(sorted, brute_terms(rows)))))
    got = sorted(str((x.text or "", sorted({s.value.lower() for s in x.spans if s.kind == 4}))) for x in pii.with_spans(frame(spark, rows).repartition(4)).collect())
    assert got == want and sum("[]" not in x for x in want) > 50


def test_ten_thousand_entities_in_one_text(spark):
    text = " ".join(f"Ann{i % 7} p{i}@mail.org, +1 {10**9 + i}" for i in range(5000))
    x = pii.stage(spark, frame(spark, [(1, text), (2, "none here")]), "").where("doc_id = 1").first()
    assert x.text == " ".join(f"Ann{i % 7} [EMAIL], [PHONE]" for i in range(5000))


def test_overlapping_spans_are_masked(spark):
    row = spark.range(1).select(pii.sanitised(F.lit("abcdefgh"), F.expr("array(named_struct('start', 1, 'kind', 0, 'end', 4, 'value', ''), named_struct('start', 3, 'kind', 3, 'end', 6, 'value', ''))")).alias("x")).first()
    assert row.x == "a[EMAIL]gh"


def test_long_texts_are_masked_at_every_chunk(spark):
    r = random.Random(6)
    spans, at = [], 0
    while at < 5000:
        a = at + r.choice([0, 1, 3, 500, 512, 513, 1100])
        spans.append((a, r.randrange(5), a + r.choice([1, 5, 512, 600]), ""))
        at = a + r.choice([0, 2, 600])
    text = "".join(chr(r.choice([97, 233, 0x1F600])) for _ in range(spans[-1][2] + r.choice([0, 700])))
    out, now = [], 0
    for a, k, b, _ in spans:
        if a >= now:
            out += [text[now:a], f"[{pii.KINDS[k].upper()}]"]
        now = max(now, b)
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,kind:int,end:int,value:string>>")
    assert df.select(pii.sanitised(F.col("t"), F.col("s")).alias("x")).first().x == "".join(out) + text[now:]


@pytest.mark.parametrize("name", ["odd", "clashing", "none"])
def test_odd_tables(spark, name, request):
    docs = request.getfixturevalue(name)
    kept = pii.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count()
