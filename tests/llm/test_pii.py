import hashlib
import random
import re

from lithic.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_matches_the_patterns():
    rng = random.Random(1)
    bits = ["a", "é", "@", ".", "..", "-", "+", " ", "\n", "1", "23", "255", "300", "0007", "(", ")", "4785380592391139", "+1 (743) 555-3824", "x.y@b.co", "10.0.0.1", "_%", "1 2-3", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == slow_base(text), text


def test_long_texts_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@a" * 150_000, "+1" * 150_000, "1 " * 100_000, "." * 300_000 + "@"):
        pii.base_spans(text)
        pii.windows(text)


def test_windows_cover_every_signal_word():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b1", "@", " ", " ", "\n", "cc", "7"]) for _ in range(40))
        runs = pii.windows(text)
        flat = [w for r in runs for w in r]
        assert flat == sorted(set(flat)) and set(flat) <= {m.span() for m in pii._WORD.finditer(text)}
        assert {m.span() for m in pii._WORD.finditer(text) if re.search("[0-9@]", m[0])} <= set(flat)


def test_field_learns_and_generalises():
    field = pii.train()
    held = pii.labelled_rows(3, seed=77)
    right = 0
    for text, start, end, kind in held:
        words = [m.span() for m in pii._WORD.finditer(text)]
        path = field.decode([pii.features([text[a:b] for a, b in words])])[0]
        want = [bool(kind) and a < end and start < b for a, b in words]
        right += want == [bool(p) for p in path]
    assert right / len(held) > 0.95
    got = pii.spans(["ring (212) 555-0199 tonight", "plain words only", "order 4785380592391131 shipped in 2019"], field)
    assert pii.shown(got[0][1]) == "phone:5:19" and got[1] == ([], []) and got[2][1] == []


def test_query_rows(spark):
    texts = [None, "", "mail a.b@c.org now", "+1 (743) 555-3824, 1.2.3.4", "x" * 200_000 + " 4111 1111 1111 1111", "a@b.co a@b.co"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, *texts])], "doc_id long, text string, n_ip int")
    got = queries.pii_rows(docs).collect()
    assert len(got) == 12
    for r in got:
        base = slow_base(texts[r.doc_id % 6] or "")
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(filter(None, shown.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and [r.text for r in clean.orderBy("doc_id").collect()][2] == "mail <EMAIL> now"
    assert pii.redacted(docs.limit(0)).count() == 0
