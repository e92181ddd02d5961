"""Personal data and secrets by weak supervision.

Strict patterns give base spans, which always stay. Wider patterns give candidates, secrets among
them; regex, gazetteer, context, boundary and shape labelers vote on each (1 for, -1 against, 0 abstains).
Votes are counted by pattern, a bounded table, on which expectation-maximisation estimates how
each labeler votes on true and false candidates, abstentions aside. A logistic span classifier over features of the
span and its context is then fitted to the posteriors of a bounded sample, and adds the candidates it accepts.

All rows are handled by DataFrame functions. The driver sees the counts of vote patterns and the sample's features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import spread, stage_table, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the method adds; those beyond KINDS have no base.
ALL = (*KINDS, "secret")
#: The base patterns, written so that no start is tried twice: a match begins where a run does, or
#: where the last match ended (\\G), and runs are possessive, so a scan is linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/.-])(?=[0-9_+/.-]*+[A-Za-z])(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9_+/.-]{16,512}+(?![A-Za-z0-9_+/.-])={0,2}",
}
ANY_LOOSE = "|".join(LOOSE.values())
#: What a text must hold for a pattern to match, by plain search.
NEEDS = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",), "loose": ("@", "[at", "(at")}

# Gazetteers, context words and formats of the labelers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "io", "co", "dev", "app", "ai", "eu", "de", "fr", "es", "it", "uk", "nl", "ch", "at", "be", "pl", "se", "ru", "cn", "jp", "in", "br", "mx", "ca", "au", "us")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
CONTEXT = {
    "email": "mail|contact|write to|correo|courriel|kontakt",
    "ip": r"\bip\b|server|host|address|adresse|login|client",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|\btel|call|mobile|fax|telefon|llama",
    "secret": "token|secret|passw|pwd|passphrase|credential|bearer|auth|api.?key|access.?key|private.?key",
}
AGAINST = r"version|isbn|order|invoice|sku|\bref|\bv\.?$|build|date|commit|checksum|uuid|revision"
SECRET_FORMATS = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+|(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}))$"
NO_SECRET = r"(?i:www\.|\.(?:com|org|net|html?|php|txt|pdf|png|jpe?g)\b)|^[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:^|[./_-])[a-z]{2,}[./_-][a-z]"
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "sk_", "AIza", "eyJ")
LABELERS = ("regex", "gazetteer", "context", "edges", "shape")
ROUNDS = 60
STRICT, TRUST = 0.99, (2.0, 8.0)
#: Candidates of each kind that the span classifier is fitted to, by smallest hash.
SAMPLE = 20_000
#: Classes that the word before a candidate is hashed to, and those of the characters around it.
WORDS, AROUND = 32, ("", " ", "\n", "=", ":", '"', "'", "(", "<", ",")
NUMBERS = ("length", "digits", "capitals", "marks", "different", "turns")


def _found(pattern: str, needs: tuple, digits: bool):
    """Values of all matches, and the gaps around them as (length, last 40 characters, first character); null if the text can't hold any."""
    text = F.coalesce("text", F.lit(""))
    test = F.lit(False)
    for n in needs:
        test |= F.contains(text, F.lit(n))
    test = text.rlike("[0-9]") & test if digits and needs else text.rlike("[0-9]") if digits else test
    values = F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(40)).alias("tail"), F.left(p, F.lit(1)).alias("head")))
    return values, gaps


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (rid, doc_id) and one row for each match: (rid, doc_id, way, pos, value, start, end, tail, head).

    way is the base kind's number, or len(KINDS) for a loose match.
    """
    rows = docs.select("doc_id", "text")
    loose = F.coalesce("text", F.lit("")).rlike("[0-9]")
    for n in NEEDS["loose"]:
        loose |= F.contains(F.coalesce("text", F.lit("")), F.lit(n))
    for k, (kind, pattern) in enumerate([*BASE.items(), ("loose", ANY_LOOSE)]):
        values, gaps = _found(pattern, NEEDS[kind], kind != "email")
        if kind == "loose":
            values = F.when(loose, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)))
        rows = rows.withColumn(f"v{k}", values).withColumn(f"g{k}", F.when(F.size(f"v{k}") > 0, gaps))
    ways = range(len(KINDS) + 1)
    found = F.array(*(F.struct(F.lit(k).alias("way"), F.col(f"v{k}").alias("values"), F.col(f"g{k}").alias("gaps")) for k in ways))
    found = F.filter(found, lambda x: F.coalesce(F.size(x["values"]), F.lit(0)) > 0)
    rows = stage_table(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", found.alias("found")), "pii-matches")
    each = rows.select("rid", "doc_id", F.explode("found").alias("f")).select("rid", "doc_id", "f.way", "f.gaps", F.posexplode("f.values").alias("pos", "value"))
    gap, after = F.element_at("gaps", F.col("pos") + 1), F.element_at("gaps", F.col("pos") + 2)
    each = each.select("rid", "doc_id", "way", "pos", "value", gap["n"].alias("gap"), gap["tail"].alias("tail"), after["head"].alias("head"))
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("rid", "way").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return rows.select("rid", "doc_id"), each


def _with_kind(each: DataFrame) -> DataFrame:
    """Adds kind, digits and whether a base match is valid; drops failing base matches."""
    loose = F.when(F.col("value").rlike(r"@|[\[(]at[\])]"), "email").when(F.col("value").rlike(f"^(?:{LOOSE['ip']})$"), "ip")
    loose = loose.when(F.col("value").rlike(f"^(?:{LOOSE['card']})$"), "card").when(F.col("value").rlike("[A-Za-z]"), "secret").otherwise("phone")
    kind = F.when(F.col("way") < len(KINDS), F.element_at(F.array(*map(F.lit, KINDS)), F.col("way") + 1)).otherwise(loose)
    each = each.withColumn("kind", kind).withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    n = F.length("digits")
    parts = F.forall(F.split("value", r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        F.split("value", r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(p.try_cast("long"), F.lit(999))).otherwise(999) <= 255
    )
    valid = F.when(F.col("kind") == "email", F.col("value").rlike(f"^(?:{BASE['email']})$")).when(F.col("kind") == "ip", F.col("value").contains(":") | (F.col("value").rlike(r"^[0-9.]+$") & parts))
    valid = valid.when(F.col("kind") == "card", (n >= 14) & (n <= 19) & F.expr("coalesce(luhn_check(digits), false)")).when(F.col("kind") == "secret", F.col("value").rlike(SECRET_FORMATS))
    valid = valid.otherwise((n >= 10) & (n <= 15) & F.startswith("value", F.lit("+")))
    each = each.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("base", F.col("way") < len(KINDS))
    return each.where(~F.col("base") | F.col("valid"))


def _votes(each: DataFrame) -> DataFrame:
    """The labelers' votes. One votes against only on what speaks against the kind, and abstains where it knows nothing."""
    kind, value, tail = F.col("kind"), F.col("value"), F.lower(F.coalesce("tail", F.lit("")))
    yes = lambda c: F.when(c, 1).otherwise(-1)
    last = F.lower(F.element_at(F.split(value, r"[.\s)\]]+"), -1))
    first = F.element_at(F.split(value, r"\."), 1).try_cast("int")
    code = F.regexp_extract(value, r"^\+([0-9]{1,3})", 1)
    known = F.array(*map(F.lit, CALLING_CODES))
    # A checksum or a number out of range speaks against a card or an address, and names of sites, paths and dates are no
    # secrets; another way of writing doesn't speak against a kind.
    strict = F.when(F.col("valid"), 1).when(kind.isin("card", "ip") | ((kind == "secret") & value.rlike(NO_SECRET)), -1).otherwise(0)
    gazetteer = F.when(kind == "email", yes(last.isin(*TOP_DOMAINS)))
    gazetteer = gazetteer.when(kind == "ip", F.when(value.contains(":"), 0).otherwise(yes((first > 0) & (first < 240))))
    gazetteer = gazetteer.when(kind == "card", yes(F.left("digits", F.lit(1)).isin("3", "4", "5", "6")))
    begins = F.lit(False)
    for start in SECRET_STARTS:
        begins |= F.startswith(value, F.lit(start))
    gazetteer = gazetteer.when(kind == "secret", F.when(begins, 1).otherwise(0))
    gazetteer = gazetteer.otherwise(F.when(code == "", 0).otherwise(yes(F.array_contains(known, code) | F.array_contains(known, F.left(code, F.lit(2))) | F.array_contains(known, F.left(code, F.lit(1))))))
    near = F.lit(False)
    for k in ALL:
        near |= (kind == k) & tail.rlike(CONTEXT[k])
    context = F.when(near, 1).when(tail.rlike(AGAINST), -1).otherwise(0)
    edges = yes(~tail.rlike("[a-z0-9_]$") & ~F.coalesce("head", F.lit("")).rlike("^[A-Za-z0-9_]"))
    n, letters = F.length("digits"), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    shape = F.when(kind == "email", yes(F.length(value) <= 64)).when(kind == "ip", yes(~value.rlike(r"(?:^|\.)0[0-9]"))).when(kind == "card", yes(n.isin(15, 16)))
    different = F.size(F.array_distinct(F.split(value, "")))
    shape = shape.when(kind == "secret", yes((n >= 3) & (letters >= 3) & (different >= 8) & ~value.rlike(r"[A-Za-z]{9}") & ~value.rlike(r"^[A-Za-z]+[0-9]{1,4}$")))
    shape = shape.otherwise(yes((n >= 10) & (n <= 13) & value.rlike(r"[+()]|-[0-9]+-|\.[0-9]+\.")))
    votes = {"regex": strict, "gazetteer": gazetteer, "context": context, "edges": edges, "shape": shape}
    return each.withColumns({n: F.coalesce(c, F.lit(0)).cast("int") for n, c in votes.items()})


def _features(each: DataFrame) -> DataFrame:
    """Numbers of the span, and classes of the word and the characters around it."""
    value, size = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")).cast("double") / size
    tail = F.coalesce("tail", F.lit(""))
    word = F.lower(F.regexp_extract(tail, r"(\p{L}+)[^\p{L}]*$", 1))
    around = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, AROUND)), c), F.lit(0)) - 1, F.lit(len(AROUND))).cast("int")
    turns = F.size(F.regexp_extract_all(value, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0)))
    numbers = (F.log(size), share("[^0-9]"), share("[^A-Z]"), share("[0-9A-Za-z]"), F.size(F.array_distinct(F.split(value, ""))) / size, turns / size)
    return each.withColumns(
        {
            **{n: c.cast("double") for n, c in zip(NUMBERS, numbers, strict=True)},
            "word": F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(WORDS))).cast("int"),
            "front": around(F.right(tail, F.lit(1))),
            "back": around(F.coalesce("head", F.lit(""))),
        }
    )


def reliabilities(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """EM of a two-class model with independent labelers: (posterior of each pattern, P(vote for | class, votes at all), share of class 1).

    votes: patterns by labelers in {-1, 0, 1}, the strict patterns' vote first; n: how often each occurs. Abstentions say
    nothing. Strict patterns and checksums are right in STRICT of all cases, which fixes what the classes mean; the
    others' reliabilities are estimated, with TRUST votes against and for what they say to begin with.
    """
    p = 1 / (1 + np.exp(-(votes.sum(axis=1, dtype=float) + 3 * votes[:, 0])))
    for _ in range(ROUNDS):
        weight = np.stack([(1 - p) * n, p * n])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        good = (weight @ (votes == 1) + np.array(TRUST)[:, None]) / (weight @ (votes != 0) + sum(TRUST))
        good[:, 0] = 1 - STRICT, STRICT
        log = (votes == 1) @ np.log(good.T) + (votes == -1) @ np.log(1 - good.T)
        p = 1 / (1 + np.exp(np.clip(log[:, 0] + np.log(1 - share) - log[:, 1] - np.log(share), -30, 30)))
    return p, good, share


def logistic(x: np.ndarray, goal: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge logistic weights for soft goals, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (goal - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def design(rows: list) -> np.ndarray:
    """A constant, votes, numbers and the classes' indicators of candidates."""
    x = np.array([[1.0, *(r[c] for c in LABELERS), *(r[c] for c in NUMBERS)] for r in rows])
    hot = [np.array([r[c] for r in rows])[:, None] == np.arange(k) for c, k in (("word", WORDS), ("front", len(AROUND) + 1), ("back", len(AROUND) + 1))]
    return np.hstack([x, *hot])


def classifier(counts: list, sample: list) -> dict[str, np.ndarray]:
    """Weights of each kind over design()."""
    out = {}
    for kind in ALL:
        own, some = [r for r in counts if r["kind"] == kind], [r for r in sample if r["kind"] == kind]
        if not own or not some:
            continue
        own.sort(key=lambda r: tuple(r[c] for c in LABELERS))
        votes = np.array([[r[c] for c in LABELERS] for r in own], np.int64)
        goal, _, _ = reliabilities(votes, np.array([r["n"] for r in own], np.float64))
        of = {tuple(v): p for v, p in zip(votes.tolist(), goal, strict=True)}
        x = design(some)
        out[kind] = logistic(x, np.array([of[tuple(r[c] for c in LABELERS)] for r in some]), np.ones(len(x)))
    return out


def _score(weights: dict[str, np.ndarray]):
    """The classifier's log odds as a column; null for kinds without one."""
    score = F.lit(None).cast("double")
    for kind, w in weights.items():
        w = [float(x) for x in w]
        numbers = (*LABELERS, *NUMBERS)
        c = F.lit(w[0])
        for name, x in zip(numbers, w[1:], strict=False):
            c = c + F.col(name) * x
        at = 1 + len(numbers)
        for name, k in (("word", WORDS), ("front", len(AROUND) + 1), ("back", len(AROUND) + 1)):
            c = c + F.coalesce(F.get(F.array(*map(F.lit, w[at : at + k])), F.col(name)), F.lit(0.0))
            at += k
        score = F.when(F.col("kind") == kind, c).otherwise(score)
    return score


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_secret, n_spans) for each row of docs.

    docs needs doc_id and text; other columns are ignored. Spans are kind:start:end in code points, by
    start and then kind; counts and base_spans are of the base, spans adds what the classifier
    accepts outside all base spans and no checksum or strict pattern speaks against, n_secret and n_spans count secrets and all spans. Null and empty texts have none; a very
    long text is searched whole, in time that is linear in it; repeated rows give repeated
    results; an empty table gives no rows.
    """
    rows, each = matches(docs)
    each = _features(_votes(_with_kind(each)))
    each = stage_table(each.select("rid", "doc_id", "kind", "base", "start", "end", *LABELERS, *NUMBERS, "word", "front", "back"), "pii-candidates")
    loose = each.where(~F.col("base"))
    # At most len(ALL) * 3^len(LABELERS) patterns, and SAMPLE candidates of a kind.
    counts = loose.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()
    sample = []
    for kind in sorted({r["kind"] for r in counts}):
        own = loose.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id", "start", "end"), "doc_id", "start", *NUMBERS, *LABELERS)
        sample += own.select("kind", *LABELERS, *NUMBERS, "word", "front", "back").limit(SAMPLE).collect()
    each = each.withColumn("score", _score(classifier(counts, sample)))
    order = Window.partitionBy("rid").orderBy("start", "end", "base", "kind")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    each = each.withColumn("free", free).where(F.col("base") | (F.col("free") & (F.col("regex") >= 0) & (F.col("score") >= 0)))
    place = F.array_position(F.array(*map(F.lit, ALL)), F.col("kind"))
    span = F.struct("start", place.alias("place"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["span"]), ",")
    number = {**{f"n_{k}": F.col("base") & (F.col("kind") == k) for k in KINDS}, "n_secret": F.col("kind") == "secret", "n_spans": F.lit(True)}
    found = each.groupBy("rid").agg(*(F.sum(c.cast("long")).alias(n) for n, c in number.items()), joined(F.when(F.col("base"), span)).alias("base_spans"), joined(span).alias("spans"))
    out = rows.join(found, "rid", "left")
    counted = {n: F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in number}
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")]
    return out.select("doc_id", *(counted[f"n_{k}"] for k in KINDS), *texts, counted["n_secret"], counted["n_spans"])


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_personal() in all documents, with the digest of the base spans."""
    found = find_personal(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_secret", "n_spans")
