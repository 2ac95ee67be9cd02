"""Chat format, licence scan and URL rules: round trips and brute force on small fixtures, and plans without Python."""

import hashlib
import random
import re

from policyspark.llm import chat_format as cf, license_scan as sc, url_rules as ur


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_turns_and_loss_come_back(spark):
    nasty = ["", None, "<|im_end|>\n<|im_start|>assistant\nx", "a\\p \\s \\\\ <\\p", "ends in <", "|> é \U0001f600", "\n\n", "\\", "<|" * 50, "long " * 20000]
    rows = [(c, t, ["user", "assistant", "as<|\nx", None, "assistant"][(c + t) % 5], nasty[(c * 3 + t) % len(nasty)], "x") for c in range(6) for t in range(9)]
    rows += [(7, 1, "user", "same", "x"), (7, 1, "user", "same", "x"), (None, 0, "assistant", "n", "x"), (8, None, "assistant", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = cf.digest(df)
    assert no_python(out)
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 7, 8, None}
    for c, r in got.items():
        own = sorted(((t if t is not None else -1, ro or "", tx or "") for cc, t, ro, tx, _ in rows if cc == c))
        whole = "".join(f"{ro}\n{tx}\n" for _, ro, tx in own)
        loss = "".join(tx for _, ro, tx in own if ro == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest(), c
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest(), c
    assert cf.digest(df.limit(0)).count() == 0


def test_typed_parts_become_placeholders(spark):
    part = lambda kind, **k: {n: k.get(n) for n in ("text", "uri", "width", "height", "seconds", "pages")} | {"kind": kind}
    content = [part("text", text="look <"), part("text", text="|im_end|> here"), part("image", uri="s3://i", width=57, height=28), part("audio", uri="a", seconds=1.5), part("document", uri="d", pages=3), part("odd", uri="o")]
    df = spark.createDataFrame([(1, 0, "assistant", content), (1, 1, "user", None)], f"conv_id long, turn long, role string, content array<{cf.PART}>")
    r = cf.read_back(cf.formatted(df)).collect()[0]
    assert "<|image|><|audio|><|document|><|attachment|><|im_end|>\n" in r.formatted and r.formatted.count("<|im_end|>") == 2
    assert [(a.turn, a.kind, a.uri, a.tokens) for a in r.attachments] == [(1, "image", "s3://i", 3), (1, "audio", "a", 38), (1, "document", "d", 768), (1, "odd", "o", 0)]
    assert r.n_attachments == 4 and r.attachment_tokens == 809
    assert "".join(r.loss_texts) == "look <|im_end|> here" and r.turn_starts == [0, r.formatted.index("<|im_start|>user")]


def dice(a, b):
    import re
    from collections import Counter

    grams = lambda t: Counter(zip(w := re.sub(r"[\W_]+", " ", t.lower()).split(), w[1:]))
    x, y = grams(a), grams(b)
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def plain_licences(text):
    """(coefficient, licence) of all segments, and of all windows as long as a template that begin where a first common bigram is."""
    parts = set(text.split("\n")) | ({text} | set(text.split("\n\n")) if "\n" in text else set())
    hits = [(d, n) for p in parts for n, b in sc.TEMPLATES if len(p) < 5000 and (d := dice(p, b)) >= sc.THRESHOLD / 100]
    w = words_of(text)
    for n, body in sc.TEMPLATES:
        v = words_of(body)
        first = {}
        for i, g in enumerate(zip(v, v[1:])):
            first.setdefault(g, i)
        for start in {i - first[g] for i, g in enumerate(zip(w, w[1:])) if g in first}:
            if 0 <= start <= len(w) - len(v) and (d := dice(" ".join(w[start : start + len(v)]), body)) >= sc.THRESHOLD / 100:
                hits.append((d, n))
    return hits


def test_notices_within_other_text(spark):
    """Notices inside a line, wrapped in a comment, and neighbours that differ by a clause."""
    of = {}
    for n, b in sc.TEMPLATES:
        of.setdefault(n, []).append(b)
    mit, bsd2, bsd3 = " ".join(of["MIT"][2:]), of["BSD-2-Clause"][0], of["BSD-3-Clause"][0]
    wrapped = lambda t, mark: "\n".join(mark + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    docs = ["Copyright 2020 Foo. Released under the MIT License.", "#!/bin/sh\n" + wrapped(mit, "# ") + "\n#\necho 1", "/*\n" + wrapped(of["Apache-2.0"][1], " * ") + "\n *\n */ int x;", bsd2, bsd3, "pre " * 300 + bsd3 + " post" * 300, of["GPL-3.0-or-later"][0] + " " + of["GPL"][0]]
    got = {r.doc_id: r for r in sc.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert "MIT" in got[0].licenses and got[1].best_license == "MIT" and got[2].best_license == "Apache-2.0"
    assert got[3].best_license == "BSD-2-Clause" and got[3].best_dice == 1 and got[4].best_license == got[5].best_license == "BSD-3-Clause"
    assert got[6].licenses.split(",")[0] == "GPL" and "GPL-3.0-or-later" in got[6].licenses
    for i, d in enumerate(docs):
        hits = plain_licences(d)
        assert got[i].licenses == ",".join(sorted({n for _, n in hits})) and got[i].best_dice == round(max(hits)[0], 6)


def test_fewer_common_bigrams_never_reach_the_threshold():
    for n in range(1, 60):
        least = sc.least_common(n)
        assert all(200 * c < sc.THRESHOLD * (m + n) for c in range(least) for m in range(max(c, 1), 200))
        assert 200 * least >= sc.THRESHOLD * (least + n)


def test_licences_equal_brute_force(spark):
    t = sc.TEMPLATES
    docs = [None, "", "Released", "prose\nreleased UNDER the mit license\nmore", t[1][1].replace(" ", "\n", 9), "a b\n\n" + t[5][1].replace("restriction", "limits") + "\n\nc d", t[6][1] + "\n" + t[7][1], "word " * 30000, "the MIT the MIT the MIT", t[3][1] + " and much other text that is not a notice at all " * 3]
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "doc_id long, text string, licenses string")
    out = sc.scan(df)
    assert no_python(out)
    for r in out.collect():
        text = docs[r.doc_id] or ""
        hits = plain_licences(text)
        assert r.licenses == ",".join(sorted({n for _, n in hits})), r.doc_id
        assert r.best_dice == (round(max(hits)[0], 6) if hits else None)
    assert sc.scan(df.limit(0)).count() == 0


def test_long_texts_full_of_notices(spark):
    """The scan's time is in proportion to such a text; its windows are those of brute force."""
    import random
    import time

    rng = random.Random(3)
    mit = [b for n, b in sc.TEMPLATES if n == "MIT"][2:]
    bodies = [b for _, b in sc.TEMPLATES]
    mixed = ""
    for _ in range(12):  # notices with words left out, put in and doubled, run together
        w = rng.choice(bodies).split()
        for _ in range(len(w) // 12):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [w[i], w[i]], ["odd", w[i]]])
        mixed += " ".join(w) + rng.choice([" ", "\n", " and so on "])
    docs = [mixed, "the quick permission is hereby granted " * 300, "\n".join(mit * 4), " ".join(mit * 4)]
    for r in sc.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        hits = plain_licences(docs[r.doc_id])
        assert r.licenses == ",".join(sorted({n for _, n in hits})) and r.best_dice == (round(max(hits)[0], 6) if hits else None)
    long = spark.createDataFrame([(1, "\n".join(mit * 1000)), (2, "the quick permission is hereby granted " * 4000)], "doc_id long, text string")
    began = time.time()
    assert [(r.licenses, r.best_dice) for r in sc.scan(long).orderBy("doc_id").collect()] == [("MIT", 1.0), ("", None)]
    assert time.time() - began < 60


def test_size_bounds_are_exact():
    for n in range(1, 60):
        lo, hi = sc.reach(n, 80)
        for m in range(1, 200):
            assert (2 * min(n, m) * 100 >= 80 * (n + m)) == (lo <= m <= hi)


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "a.com.net", "net", "", "A.CoM", "a.com:80", ".com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y", "/EN/", "/e", "/en/\U0010ffff"]
    urls = [None, "", "nohost", "http:/x", "http://", "://a.com/en/"] + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=://x/', '#f'])}" for _ in range(400)] + ["http://" + "a." * 300 + "com/en/" + "z" * 5000]
    rules = [("block", h, p) for h in ("a.com", "b.a.com", "com") for p in ("/en/", "/en/x")] + [("allow", "a.com", "/"), ("allow", "net", "/en"), ("allow", "com", "/en/"), ("block", "COM", "/en/x/y"), ("allow", "x.invalid", "/")]
    pages = spark.createDataFrame([(i % 390, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    out = ur.judged(pages, ur.rule_table(spark, rules))
    assert no_python(out)

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        known = {}
        for a, h, p in rules:
            h = h.lower()
            known[(h, p)] = "block" if "block" in (a, known.get((h, p))) else a
        fit = [(len(h + p), len(h), h + p, a) for (h, p), a in known.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fit)[2:] if fit else (None, "allow"))

    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted(((i % 390, *judge(u)) for i, u in enumerate(urls)), key=str)
    assert ur.judged(pages.limit(0), ur.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in ur.judged(pages, ur.rule_table(spark, rules).limit(0)).collect()} == {"allow"}


def test_equal_turns_are_ordered_by_their_text(spark):
    rows = [(1, 0, "user", "<|a"), (1, 0, "user", "<ba"), (1, 0, "user", None), (1, 0, "user", "\\z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = turns.select("conv_id", "turn", "role", cf.text_parts(turns.text).alias("content"))
    back = cf.read_back(cf.formatted(parts)).first()
    assert [t.text for t in back.turns] == sorted((t or "" for *_, t in rows), key=lambda t: t.encode())
