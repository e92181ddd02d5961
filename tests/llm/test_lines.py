"""Line spread against exact counts."""

from collections import defaultdict

from millrace.llm import lines


def brute(rows, sites):
    """Cleaned text and numbers of lines for rows (text, source)."""
    seen = defaultdict(set)
    for t, s in rows:
        for x in (t or "").split("\n") if t is not None else ():
            if x.strip(" "):
                seen[x.strip(" ")].add(s)
    bad = {x for x, s in seen.items() if len(s) >= sites}
    out = []
    for t, _ in rows:
        if t is None:
            out.append((None, 0, 0))
        else:
            kept = [x for x in t.split("\n") if x.strip(" ") not in bad]
            out.append(("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    return out


def key(rows):
    return sorted((t is not None, t or "", n, g) for t, n, g in rows)


def test_spread(spark):
    rows = []
    for k in range(400):
        own = [f"line number {j} that stands on some sites" for j in range(60) if k % (j + 1) == 0]
        rows.append(("\n".join([*own, f"own line of document {k} here", "Les.", "", " " * (k % 5), "\t", "a" if k % 40 < 12 else "b", "  line number 0 that stands on some sites "]), f"site{k % 40}" if k % 11 else None))
    df = spark.createDataFrame([(t, s, *"uvwxyz") for t, s in rows], "text string, source string, n_lines string, pos string, t1 string, __t1 string, Gone string, `l1.x` string")
    for sites in (10, 25):
        out = lines.drop_boilerplate(df, sites).collect()
        assert key((r["text"], r["n_lines"], r["n_removed"]) for r in out) == key(brute(rows, sites))
        assert {(r["pos"], r["t1"], r["__t1"], r["Gone"], r["l1.x"]) for r in out} == {tuple("vwxyz")}
        assert not any(x == "Les." for r in out for x in r["text"].split("\n"))


def test_odd_rows(odd, odd_rows, none):
    out = lines.drop_boilerplate(odd, 2)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == odd.columns
    assert key((r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()) == key(brute([(r[1], r[3]) for r in odd_rows], 2))
    assert lines.drop_boilerplate(none).collect() == []
