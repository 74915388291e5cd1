"""Personal data: patterns against plain regular expressions, terms against counted co-occurrence."""

from __future__ import annotations

import math
import random
import re

from rowtide.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


HARD = [
    "a@b.c", "a@b", "a@b.", "a@b.c.d-e.", "@b.c", "x@y@z.com", "a..b@c.d x%y+z@q-r.st", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "01.02.003.255", "1.2.3", "1.2.3.4.5", "999.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111",
    "4111  1111 1111 1111", "41111111111111111111111111", "4111 1111 1111 1112", "0 0 0 0 0 0 0 0 0 0 0 0", "000000000000", "+1 (555) 123-4567", "+1", "+12", "+123", "+49 30 1234567 ", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "++1 555 123 4567",
    "+44 20 7946 0958.", "é+1 555 123 4567 a@b.cd 10.0.0.1", "👩 4111111111111111 👩", "12-34-56-78-90-12 345", "a@b.c,d@e.f;10.0.0.1", "call +1-555-123-4567 or +1-555-123-4568", "a@b.c@d.e", "1.2.3.4@5.6", "٣٣٣ 1.2.3.٤", "4111 1111 1111 1111",
]


def spans(row):
    return [f"{s.kind}:{s.start}:{s.end}" for s in row]


def test_base_spans(documents):
    rng = random.Random(8)
    alphabet = "0123456789  ..--++()@ab,%é\n"
    rand = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(600)]
    digits = ["".join(rng.choice("0123456789 -") for _ in range(rng.randint(10, 60))) for _ in range(200)]
    texts = [None, "", *HARD, *rand, *digits]
    docs = documents(list(enumerate(texts)))
    out = {r.doc_id: r for r in pii.find_spans(docs, threshold=1000.0).select("doc_id", "_base", "_spans").collect()}
    for i, text in enumerate(texts):
        assert spans(out[i]["_base"]) == brute(text), repr(text)
        assert spans(out[i]["_spans"]) == brute(text)


def test_query_digests_over_the_small_table(spark, small):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op10_pii(spark, small).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(f"{k}:") for s in want) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))


def test_long_runs_take_time_in_proportion(documents):
    texts = ["1" * 8_000, "a" * 8_000, "1 " * 8_000, "+1 " * 8_000, "1." * 8_000, "a@" * 8_000]
    out = pii.find_spans(documents(list(enumerate(texts)))).select("doc_id", "_base").collect()
    assert {r.doc_id: spans(r["_base"]) for r in out} == {i: brute(t) for i, t in enumerate(texts)}


def test_disclosing_terms(documents):
    """A name that only ever stands beside one address discloses it; common words do not."""
    rng = random.Random(6)
    words = ["report", "weekly", "office", "number", "please", "garden", "window", "yellow"]
    filler = lambda: " ".join(rng.choice(words) for _ in range(12))
    rows = [(i, f"{filler()} write to Zephyrine at z.q@mail.example {filler()}") for i in range(4)]
    rows += [(10 + i, f"{filler()} ask desk@mail.example {filler()}") for i in range(6)]
    rows += [(100 + i, filler()) for i in range(40)]
    out = {r.doc_id: r for r in pii.find_spans(documents(rows)).select("doc_id", "text", "_base", "_spans").collect()}
    for i in range(4):
        terms = {out[i].text[s.start : s.end] for s in out[i]["_spans"] if s.kind == "term"}
        assert "Zephyrine" in terms
        assert not terms & set(words)
    assert all(r["_spans"] == [] for i, r in out.items() if i >= 100)
    n, together, entity, term = len(rows), 4, 4, 4
    assert math.log(n * together / (entity * term)) >= 0.9 * math.log(n / entity)


def counted(texts, threshold=0.9, min_documents=2, groups=None):
    """The disclosing terms of each value by plain counts over whole documents; ``groups``: the group of copies of each."""
    groups = groups or list(range(len(texts)))
    of = lambda t: re.findall(r"[^\W\d_]{2,}", t.lower())
    words = [set(of(t or "")) for t in texts]
    found = [[(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[a-z.]+@mail\.example", t or "")] for t in texts]
    values = [{"email:" + v for v, _, _ in f} for f in found]
    out = {}
    for e in set().union(*values):
        own = [k for k, v in enumerate(values) if e in v]
        with_entity = len({groups[k] for k in own})
        near: dict[str, float] = {}
        for k in own:
            for v, start, end in found[k]:
                if "email:" + v == e:
                    cased = lambda t: re.findall(r"[^\W\d_]{2,}", t)
                    for side in (cased(texts[k][:start])[::-1], cased(texts[k][end:])):
                        for d, t in enumerate(side[: pii.NEAR], 1):
                            if t[0].isupper():
                                near[t.lower()] = max(near.get(t.lower(), 0), 1 / max(1, d - 1))
        for t in set().union(*(words[k] for k in own)):
            together, every = len({groups[k] for k in own if t in words[k]}), sum(t in w for w in words)
            both = max(near.get(t, 0), together if together >= min_documents else 0)
            if both and math.log(len(texts) * both / (with_entity * every)) >= threshold * math.log(len(texts) / with_entity):
                out.setdefault(e, set()).add(t)
    return out


def test_a_name_beside_an_address_in_one_document(documents):
    rng = random.Random(36)
    words = ["report", "weekly", "office", "number", "please", "garden", "window", "yellow"]
    filler = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [(1, f"Rarity {filler()} write to Zephyrine Okonkwo z.o@mail.example {filler()}")] + [(100 + i, filler() + " write to us") for i in range(200)]
    (terms,) = [{r.text[s.start : s.end] for s in r["_spans"] if s.kind == "term"} for r in pii.find_spans(documents(rows)).collect() if r.doc_id == 1]
    assert terms == {"Zephyrine", "Okonkwo"}


def test_near_copies_are_no_evidence(documents):
    """Words of a text that stands four times with one word changed, far from its address, are no terms."""
    rng = random.Random(46)
    rare = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(60)]
    copies = []
    for i in range(4):
        own = list(rare)
        own[i * 7 + 3] = f"changed{'abcd'[i]}"
        copies.append((i, f"{' '.join(own[:30])} one two three four five six seven eight n.c@mail.example one two three four five six seven eight {' '.join(own[30:])}"))
    common_ = [(100 + i, "one two three four five six seven eight") for i in range(60)]
    held = pii.copy_groups(documents(copies).selectExpr("*", "doc_id as _row"))
    groups = {r["_copy_of"] for r in held.collect()}
    assert len(groups) == 1
    other_order = documents(copies[::-1]).repartition(3).selectExpr("*", "100 - doc_id as _row")
    assert {r["_copy_of"] for r in pii.copy_groups(other_order).collect()} == groups
    for r in pii.find_spans(documents(copies + common_)).collect():
        assert [s.kind for s in r["_spans"]] == (["email"] if r.doc_id < 4 else [])


def test_many_values_in_one_text(documents, monkeypatch):
    monkeypatch.setattr(pii, "FOLDED", 3)
    texts = [" ".join(f"a{i}@b.cd 10.0.0.{i % 256}" for i in range(n)) for n in (1, 2, 3, 4, 40, 700)]
    out = pii.find_spans(documents(list(enumerate(texts)))).select("doc_id", "_base").collect()
    assert {r.doc_id: spans(r["_base"]) for r in out} == {i: brute(t) for i, t in enumerate(texts)}


def test_terms_far_from_the_value(documents):
    """A name at the head of the text, far from the address, or near in some documents and far in others, discloses it too."""
    rng = random.Random(16)
    words = ["report", "weekly", "office", "number", "please", "garden", "window", "yellow"]
    filler = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, f"Zephyrine writes. {filler()} z.q@mail.example {filler()}") for i in range(4)]
    rows += [(10 + i, f"{'Quillon ' if i % 2 else ''}{filler()} q.l@mail.example{'' if i % 2 else ' Quillon'}") for i in range(6)]
    rows += [(20, f"Solitary {filler()} s.o@mail.example")]
    rows += [(100 + i, filler()) for i in range(40)]
    want = counted([t for _, t in rows])
    assert want["email:z.q@mail.example"] == {"zephyrine", "writes"}
    assert want["email:q.l@mail.example"] == {"quillon"}
    for r in pii.find_spans(documents(rows)).select("doc_id", "text", "_spans").collect():
        got = {r.text[s.start : s.end].lower() for s in r["_spans"] if s.kind == "term"}
        assert got == ({"zephyrine", "writes"} if r.doc_id < 10 else {"quillon"} if r.doc_id < 20 else set())
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert not any("Zephyrine" in t or "Quillon" in t for t in clean.values())
    assert "Solitary" in clean[20]


def test_terms_are_those_of_plain_counts(spark, documents, monkeypatch):
    """Random documents and several thresholds, with lists that are broadcast in whole, in part and not at all."""
    rng = random.Random(26)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(60)]
    texts = []
    for _ in range(120):
        text = [vocabulary[int(60 * rng.random() ** 2)] for _ in range(rng.randint(0, 12))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            who = rng.randint(0, 9)
            text += [f"{'qrstuvwxyz'[who]}@mail.example", rng.choice((f"own{'qrstuvwxyz'[who]}", f"rare{'qrstuvwxyz'[who]}", "other"))]
        rng.shuffle(text)
        texts.append(" ".join(w if "@" in w or rng.random() < 0.5 else w.capitalize() for w in text))
    docs = documents(list(enumerate(texts)))
    for most, threshold in ((100_000, 0.9), (12, 0.7), (0, 0.5)):
        monkeypatch.setattr(pii, "MOST_BROADCAST", most)
        held = docs.withColumn("_base", pii.base_spans(docs["text"])).where("size(_base) > 0").selectExpr("*", "doc_id as _row", "doc_id div 3 as _copy_of")
        got = {r.entity: set(r.terms) for r in pii.disclosing_terms(docs, held, threshold, 2).collect()}
        want = counted(texts, threshold, 2, [k // 3 for k in range(len(texts))])
        assert want and got == want


def test_random_rare_neighbours_stay(documents):
    """Rare lower-case words beside a value are no evidence; a name there is."""
    rng = random.Random(56)
    invented = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(8))
    rows = [(i, f"{invented()} {invented()} mail{i}@mail.example {invented()} {'Ottoline' if i == 7 else ''}") for i in range(60)]
    for r in pii.find_spans(documents(rows)).collect():
        assert [r.text[s.start : s.end] for s in r["_spans"] if s.kind == "term"] == (["Ottoline"] if r.doc_id == 7 else [])


def test_a_long_contact_list_makes_no_pairs_of_all(spark, documents):
    """5,000 values and 20,000 words in one document, and again in another with other words: pairs are held to what can disclose."""
    values = " ".join(f"v{i}@mail.example" for i in range(5000))
    words = lambda k: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{k}" for i in range(10_000))
    rows = [(1, f"{values} {words('x')}"), (2, f"{words('y')} {values}"), *((10 + i, f"v{i}@mail.example plain words") for i in range(20))]
    found = {r.doc_id: r for r in pii.find_spans(documents(rows)).selectExpr("doc_id", "size(_base) as n", "size(_spans) - size(_base) as terms").collect()}
    assert (found[1].n, found[2].n) == (5000, 5000)
    assert (found[1].terms, found[2].terms) == (0, 0)


def test_sanitise(documents):
    docs = documents([(1, "mail a@b.cd or 10.0.0.1!"), (2, None), (3, "clean"), (4, ""), (4, "1.2.3.4@5.6, 4111111111111111")])
    clean = pii.sanitise(docs, threshold=1000.0)  # values alone
    assert clean.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in clean.collect())
    assert got == [(1, "mail [EMAIL] or [IP]!"), (2, ""), (3, "clean"), (4, ""), (4, "[EMAIL], [CARD]")]
    assert pii.sanitise(documents([])).collect() == []
