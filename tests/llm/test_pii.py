"""Personal data against the plain patterns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return ",".join(s for _, _, s in sorted(found))


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal(rows).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_spans"] == want, texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in want.split(",")) for k in pii.KINDS]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


CASES = [
    "a@b.c_d@e.f g@h a@b.", "x@y.z@q.r", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 0000000000000000000001.2.3.4", "1.2.3.99999999999999999999999",
    "4845168114407329, 4845-1681-1440-7329 4845168114407328 7536784127813050 4845168114407329", "+1 (487) 555-7209 x +1 ( 2 +12345678901234567 +44 20 7946 0958", "😀 +1 (487) 555-7209 é a@é.com ä.b@c.de",
    "5 5 5-5", "+" * 50, "a.b" * 40 + "@x.y", "@@.@", "1" * 400, "", None, "[at] me [at] site [dot] org",
]


def test_base_spans(spark):
    check(spark, CASES)


def test_generated(spark):
    found = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.text(st.sampled_from("0123456789a@.+-_() é"), max_size=40))
    def collect(t):
        found.append(t)

    collect()
    check(spark, found)


def test_long_runs_are_linear(spark):
    check(spark, ["a" * 200_000, "1 " * 50_000, "a." * 50_000 + "@", "x@" + "y." * 60_000, "+1" + " " * 100_000, "1." * 60_000])


def test_adds_spans_next_to_the_base(spark):
    """Two cards behind one another fail as one run of digits; the method adds both, and no card with a wrong checksum."""
    texts = ["pay 7536784127813050 4845168114407329 now"] * 5 + ["card 4845168114407329."] * 20 + ["no 4845168114407328 card"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal(rows).collect()}
    assert got[0]["n_card"] == 0 and got[0]["spans"] == "card:4:20,card:21:37"
    assert got[30]["spans"] == "" and got[10]["spans"] == got[10]["base_spans"] == "card:5:21"


def test_odd_rows(odd, odd_rows, none):
    got = sorted((r["doc_id"] or 0, r["base_spans"]) for r in pii.find_personal(odd).collect())
    assert got == sorted((r[0] or 0, base(r[1])) for r in odd_rows)
    assert pii.find_personal(none).collect() == []


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.6)], axis=1)
    at, n = np.unique(votes, axis=0, return_counts=True)
    p, table, share = pii.reliabilities(at, n.astype(float))
    assert share == pytest.approx(0.3, abs=0.05)
    assert table[1, 0] > 0.9 and 0.5 < table[1, 2] < 0.7 and table[0, 0] < 0.1


def test_em_ignores_abstentions():
    # The strict pattern knows nothing of the last candidates; the others, found reliable elsewhere, decide.
    votes = np.array([[1, 1, 1], [-1, -1, -1], [1, 1, -1], [-1, 1, -1], [0, 1, 1], [0, -1, -1]])
    p, _, _ = pii.reliabilities(votes, np.array([400.0, 300, 20, 20, 1, 1]))
    assert p[4] > 0.9 and p[5] < 0.1 and p[0] > 0.9 and p[1] < 0.1


def test_secrets_and_other_ways_of_writing(spark):
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(7919 * k * k + 13))
    digest = lambda k, n: hashlib.sha1(str(k).encode()).hexdigest()[:n]
    texts = [f"{word(k)} {word(k + 1)} +1 (487) 555-{k:04d} {word(k + 2)} token = \"{digest(k, 40)}\" end" for k in range(60)]
    texts += [f"{word(k)} password={digest(k, 18)} and AKIA{digest(k, 16).upper()} {word(k)}" for k in range(40)]
    plain = [f"{word(k)} {word(k + 5)}, in 2024 chapter {k} of {word(k)}-{word(2 * k)} at 10:30 and undtechungverschiedene{word(k)}" for k in range(100)]
    more = ["please call 487-555-7209 today", "write to jane.roe [at] example [dot] org", "fe80:1:2:3:4:5:6:7 is up", "see https://www.example.com/a/page12345.html now", "number 4845168114407328 here"]
    rows = spark.createDataFrame(list(enumerate(texts + plain + more)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal(rows).collect()}
    for k, t in enumerate(texts):
        spans = {tuple(x.split(":")) for x in got[k]["spans"].split(",")}
        values = {(kind, t[int(a) : int(b)]) for kind, a, b in spans}
        if k < 60:
            assert ("secret", digest(k, 40)) in values and len(values) == 2 == got[k]["n_spans"]
        else:
            assert values == {("secret", digest(k - 60, 18)), ("secret", "AKIA" + digest(k - 60, 16).upper())} and got[k]["n_secret"] == 2
    assert all(got[len(texts) + k]["spans"] == "" for k in range(100))
    found = [got[len(texts) + 100 + k]["spans"] for k in range(len(more))]
    assert found == ["phone:12:24", "email:9:40", "ip:0:18", "", ""]


def test_the_span_classifier_sees_span_and_context():
    rows = [{"kind": "secret", **dict.fromkeys(pii.LABELERS, 1 - 2 * (k % 2)), **dict.fromkeys(pii.NUMBERS, 0.5), "digits": 0.9 - 0.8 * (k % 2), "word": 3 if k % 2 == 0 else 9, "front": 1, "back": 1} for k in range(200)]
    counts = [{"kind": "secret", **dict.fromkeys(pii.LABELERS, v), "n": 100} for v in (1, -1)]
    w = pii.classifier(counts, rows)["secret"]
    x = pii.design([{**rows[0], **dict.fromkeys(pii.LABELERS, 0)}, {**rows[1], **dict.fromkeys(pii.LABELERS, 0)}])
    assert x.shape[1] == len(w) and (x @ w)[0] > 0 > (x @ w)[1]


def candidates(text):
    """Loose matches with votes and features, from the definitions."""
    found, last = [], 0
    matches = list(re.finditer(pii.ANY_LOOSE, text or ""))
    for k, m in enumerate(matches):
        after = text[m.end() : matches[k + 1].start() if k + 1 < len(matches) else len(text)]
        tail, head, value = text[last : m.start()][-40:], after[:1], m[0]
        last = m.end()
        if re.search(r"@|[\[(]at[\])]", value):
            kind = "email"
        elif re.fullmatch(pii.LOOSE["ip"], value):
            kind = "ip"
        elif re.fullmatch(pii.LOOSE["card"], value):
            kind = "card"
        else:
            kind = "secret" if re.search("[A-Za-z]", value) else "phone"
        digits, low = re.sub("[^0-9]", "", value), tail.lower()
        n = len(digits)
        good = {
            "email": lambda: re.fullmatch(PLAIN["email"], value),
            "ip": lambda: ":" in value or all(int(x) <= 255 for x in value.split(".")),
            "card": lambda: 14 <= n <= 19 and luhn(digits),
            "secret": lambda: re.search(pii.SECRET_FORMATS, value),
            "phone": lambda: 10 <= n <= 15 and value[0] == "+",
        }[kind]()
        yes = lambda c: 1 if c else -1
        code = (re.match(r"\+([0-9]{1,3})", value) or ["", ""])[1]
        known = {
            "email": lambda: yes(re.split(r"[.\s)\]]+", value)[-1].lower() in pii.TOP_DOMAINS),
            "ip": lambda: 0 if ":" in value else yes(0 < int(value.split(".")[0]) < 240),
            "card": lambda: yes(digits[0] in "3456"),
            "secret": lambda: int(value.startswith(pii.SECRET_STARTS)),
            "phone": lambda: yes({code, code[:2], code[:1]} & set(pii.CALLING_CODES)) if code else 0,
        }[kind]()
        letters = sum(c.isascii() and c.isalpha() for c in value)
        shape = {
            "email": lambda: len(value) <= 64,
            "ip": lambda: not re.search(r"(?:^|\.)0[0-9]", value),
            "card": lambda: n in (15, 16),
            "secret": lambda: n >= 3 and letters >= 3 and len(set(value)) >= 8 and not re.search("[A-Za-z]{9}", value) and not re.fullmatch("[A-Za-z]+[0-9]{1,4}", value),
            "phone": lambda: 10 <= n <= 13 and re.search(r"[+()]|-[0-9]+-|\.[0-9]+\.", value),
        }[kind]()
        word = (re.search(r"([^\W\d_]+)[\W\d_]*$", tail) or ["", ""])[1].lower()
        around = lambda c: pii.AROUND.index(c) if c in pii.AROUND else len(pii.AROUND)
        size = len(value)
        found.append(
            {
                "kind": kind, "start": m.start(), "end": m.end(),
                "regex": 1 if good else -1 if kind in ("card", "ip") or (kind == "secret" and re.search(pii.NO_SECRET, value)) else 0,
                "gazetteer": known,
                "context": 1 if re.search(pii.CONTEXT[kind], low) else -1 if re.search(pii.AGAINST, low) else 0,
                "edges": yes(not re.search("[a-z0-9_]$", low) and not re.match("[A-Za-z0-9_]", head)),
                "shape": yes(shape),
                "length": np.log(size), "digits": n / size, "capitals": len(re.sub("[^A-Z]", "", value)) / size, "marks": len(re.sub("[0-9A-Za-z]", "", value)) / size,
                "different": len(set(value)) / size, "turns": len(re.findall("[A-Za-z][0-9]|[0-9][A-Za-z]", value)) / size,
                "word": xxhash.xxh64(word.encode(), seed=42).intdigest() % pii.WORDS if word else -1, "front": around(tail[-1:]), "back": around(head),
            }
        )
    return found


def brute_spans(texts):
    """All spans of each text: the base, and loose matches that the fitted classifier accepts beside it."""
    every = [candidates(t) for t in texts]
    flat = [c for own in every for c in own]
    counts = Counter((c["kind"], *(c[x] for x in pii.LABELERS)) for c in flat)
    weights = pii.classifier([dict(zip(("kind", *pii.LABELERS), k, strict=True)) | {"n": n} for k, n in counts.items()], flat)
    out = []
    for text, own in zip(texts, every, strict=True):
        spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base(text).split(",") if x)]
        free = [c for c in own if c["regex"] >= 0 and all(b <= c["start"] or a >= c["end"] for a, b, _ in spans)]
        spans += [(c["start"], c["end"], c["kind"]) for c in free if (pii.design([c]) @ weights[c["kind"]])[0] >= 0]
        out.append(",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], pii.ALL.index(x[2])))))
    return out


def test_added_spans_are_those_of_the_definition(spark):
    rng = random.Random(21)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pieces = [
        lambda: rng.choice(["the", "and", "Wörter", "call", "server", "card", "version", "token", "mail", "x"]),
        lambda: f"+{rng.choice(['1', '44', '999'])} ({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)} {number(3)} {number(4)}",
        lambda: number(16), lambda: "4845168114407329", lambda: "7536784127813050 4845168114407329", lambda: f"{rng.randrange(300)}.{rng.randrange(300)}.{rng.randrange(9)}.{rng.randrange(99)}",
        lambda: f"{rng.choice('abc')}.b@site{rng.randrange(9)}.{rng.choice(['com', 'zzz'])}", lambda: "jane [at] site [dot] org", lambda: "2001:db8:0:0:1:0:0:" + number(1),
        lambda: f'token = "{hashlib.sha1(number(5).encode()).hexdigest()}"', lambda: f"password={hashlib.md5(number(5).encode()).hexdigest()[:18]}", lambda: "AKIA" + hashlib.md5(number(5).encode()).hexdigest()[:16].upper(),
        lambda: f"https://www.site.com/path/page{number(6)}.html", lambda: f"commit {hashlib.sha1(number(5).encode()).hexdigest()}", lambda: f"report_2024_{rng.choice(['final', 'draft'])}_{number(4)}", lambda: "\n",
    ]
    texts = [" ".join(rng.choice(pieces)() if rng.random() < 0.5 else pieces[0]() for _ in range(rng.randrange(25))) for _ in range(250)] + ["", None]
    want = brute_spans(texts)
    got = {r["doc_id"]: r for r in pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert [got[k]["spans"] for k in range(len(texts))] == want
    assert all(r["n_spans"] == len(list(filter(None, r["spans"].split(",")))) and r["n_secret"] == r["spans"].count("secret:") for r in got.values())
    assert sum("secret:" in w for w in want) > 30 and sum(len(w.split(",")) for w in want) > sum(len(base(t).split(",")) for t in texts) + 50
