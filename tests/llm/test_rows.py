"""Operators that judge documents one by one or by counts, against plain re-implementations."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

from codegrain.llm import decontaminate, pii, quality_rules, suffix_tree
from tests.llm.fixtures import SCHEMA, ascii_lower, frame, rows, split


def as_multiset(found):
    return Counter(map(tuple, found))


def plain_line(line):
    return " ".join(split(line)).lower()


def brute_hot_lines(listed):
    """(host, line) above the limits; documents are the distinct sets of lines."""
    seen, hosts = {}, Counter(r[3] or "" for r in listed)
    for r in listed:
        own = frozenset(plain_line(ln) for ln in (r[1] or "").split("\n") if split(ln))
        for h in own:
            seen.setdefault((r[3] or "", h), set()).add(own)
    return {key for key, docs in seen.items() if len(docs) > 20 and len(docs) * 1000 > hosts[key[0]] * 10}


def brute_quality(listed):
    hot = brute_hot_lines(listed)
    for i, r in enumerate(listed):
        text = r[1] or ""
        w = split(text)
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = len({q for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for q in (j, j + 1, j + 2)})
        solid = [x for x in text.split("\n") if split(x)]
        gone = [len(ln) for ln in solid if (r[3] or "", plain_line(ln)) in hot]
        left = len(text) - sum(gone)
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        depleted = bool(gone) and (left < 150 or 100 * left < 50 * len(text))
        yield r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(solid) - len(set(solid)), again, len(gone), sum(gone), failed, depleted, not failed and not depleted


def test_quality_rules(spark):
    assert as_multiset(quality_rules.quality_rules(frame(spark)).collect()) == as_multiset(brute_quality(rows()))
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def test_quality_keep_keeps_rows_and_columns(spark):
    docs = frame(spark)
    kept = quality_rules.keep(spark, docs)
    assert kept.columns == docs.columns
    hot = brute_hot_lines(rows())
    good = [r for r, v in zip(rows(), brute_quality(rows())) if v[-1]]
    want = [(r[0], "\n".join(ln for ln in r[1].split("\n") if (r[3] or "", plain_line(ln)) not in hot), *r[2:]) for r in good]
    assert as_multiset(kept.collect()) == as_multiset(want) and want != good


def test_keep_with_clashing_columns_and_broadcasts_off(spark, monkeypatch):
    from pyspark.sql import functions as F

    for module in (quality_rules, decontaminate):
        monkeypatch.setattr(module, "MOST_BROADCAST", 0)
    names = ["lines", "n_gone", "host", "g_k", "row", "bad_id", "bad_k", "places", "words", "item", "__d", "__k"]
    docs = frame(spark).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    plain = quality_rules.keep(spark, frame(spark))
    clashing = quality_rules.keep(spark, docs)
    assert clashing.columns == docs.columns
    assert as_multiset(clashing.select("doc_id", "text").collect()) == as_multiset(plain.select("doc_id", "text").collect())
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    bad = {v[0] for v in brute_hits(rows(), BENCH) if v[-1]}
    left = decontaminate.keep(spark, docs, bench)
    assert left.columns == docs.columns and bad
    assert Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in rows() if r[0] not in bad)


BENCH = [(1, " ".join(split(rows()[8][1])[40:70])), (2, "c, d! E"), (3, None), (None, "one"), (4, "one"), (4, "x x x"), (5, "...")]
_W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(listed, bench):
    for r in listed:
        w = _W.findall(ascii_lower(r[1]))
        hit, items = set(), set()
        for item, text in bench:
            b = _W.findall(ascii_lower(text))
            n = min(13, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b and item is not None else set()
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins] if wins else []
            hit.update(i + j for i in at for j in range(n))
            items.update({str(item)} if at else ())
        yield r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontaminate(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for most in (decontaminate.MOST_BROADCAST, 0):
        decontaminate.MOST_BROADCAST, before = most, decontaminate.MOST_BROADCAST
        try:
            got = decontaminate.decontaminate(frame(spark), bench).drop("n_near").collect()
        finally:
            decontaminate.MOST_BROADCAST = before
        assert as_multiset(got) == as_multiset(brute_hits(rows(), BENCH))
    none = decontaminate.decontaminate(frame(spark), bench.where("false"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows())
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron"
    near = item.replace("epsilon", "other")
    docs = spark.createDataFrame([(1, near, None, None, 0, 0, "", 0, "", 0), (2, "alpha " + " ".join(item.split()[::-1]), None, None, 0, 0, "", 0, "", 0)], SCHEMA)
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (0, 1), 2: (0, 0)}


def brute_pii(text):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base_rules(spark, sf_dir):
    texts = [r[1] or "" for r in rows()] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["1.2.3.4.5.6.7.8", "a@b.co.@c.de x@y", "00010.0.0.1", "+1 23456789 +", "4539 5787-6362 1486", "é" * 5 + "a@b.cc", "1" * 5000]
    texts += ["@a.b", "a@b@c.d", "a@b.c@d.e.f", "x@y.z.@p.q@r.s", "..@..", "a@-.-", "a@@b.c", "é@b.c a%+@b.c-d.e_f"]
    rng = random.Random(8)
    texts += ["".join(rng.choice("aé@.-%0 1(+)") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == brute_pii(t), t[:80]


def test_pii_long_hostile_texts():
    n = 1 << 20
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    for text in ("a" * n + " @", "a" * n + "@", "a@" * (n // 2), "a." * (n // 2) + "@b", "@" * n, "0" * n + ".1.1", "1." * (n // 2), "+1" + " (" * (n // 2), "+" * n, "+1 " * (n // 3), "1 " * (n // 2), "1-" * (n // 2)):
        began = time.process_time()
        pii.base_spans(text)
        assert time.process_time() - began < 20, text[:10]


def test_pii_lines_that_are_skipped_have_no_span():
    field = pii.fit()
    assert field.skips and pii.most_gain(field, [field.shapes[x] for x in pii.PLAIN]) < 0
    assert pii.most_gain(field, [field.shapes[x] for x in (*pii.PLAIN, "dot", "mix16+")]) > 0
    rng = random.Random(4)
    lines = [[field.shapes[rng.choice(pii.PLAIN)] for _ in range(rng.randint(1, 40))] for _ in range(20_000)]
    assert not any(path.any() for path in field.viterbi(lines))


def test_pii_query_form(spark):
    got = as_multiset(pii.find(frame(spark)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect())
    want = []
    for r in rows():
        b = brute_pii(r[1] or "")
        kinds = [x[0] for x in b]
        want.append((r[0], *(kinds.count(k) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest()))
    assert got == as_multiset(want)
    assert pii.find(frame(spark, [])).count() == 0


def test_pii_field_learns_its_table_and_adds_spans():
    field = pii.fit()
    held = pii._table(4, seed=77)
    wrong = sum([pii.LABELS[i] for i in p] != labels for (_, labels), p in zip(held, field.viterbi([field.codes(w) for w, _ in held])))
    assert wrong <= 0.05 * len(held) and field.skips
    text = 'x tel (045) 555-9193 and token = "5d190bd7c06284de91015a36974748794293dd8a" at 5'
    (_, spans), = pii.all_spans([text], field)
    assert [(k, text[a:b]) for k, a, b in spans] == [("phone", "(045) 555-9193"), ("secret", "5d190bd7c06284de91015a36974748794293dd8a")]
    assert pii.redacted(text, spans).endswith('[SECRET]" at 5')


def test_pii_redact_keeps_rows(spark):
    docs = frame(spark)
    out = pii.redact(docs)
    assert out.schema == docs.schema and out.count() == len(rows())
    assert out.where("doc_id = 14").first().text.startswith("mail [EMAIL], 1.2.3.400 and [IP]; [PHONE], [CARD]")


def test_suffix_tree_base_scores(spark):
    import math

    listed = rows()
    held = [zlib.crc32(str(r[0]).encode()) % 7 == 2 if r[0] is not None else False for r in listed]
    toks = [split(ascii_lower(r[1])) + [None] for r in listed]
    count = Counter(t for ts, h in zip(toks, held) if not h for t in ts)
    n, v = sum(count.values()), len(count)
    want = sorted((str(r[0]), h, len(ts), sum(count[t] > 0 for t in ts), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, h, ts in zip(listed, held, toks))
    got = suffix_tree.lm_scores(frame(spark)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    nobody = suffix_tree.lm_scores(frame(spark).where("doc_id is not null"), folds=1, held_out=0).collect()
    assert {(r.n_known, r.train_tokens) for r in nobody} == {(0, 0)} and all(r.held_out and r.score < 0 for r in nobody)
    assert suffix_tree.lm_scores(frame(spark, [])).count() == 0


def test_suffix_tree_is_a_distribution_and_uses_the_longest_suffix():
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["the cat sat on the mat " * 40, "that then there " * 60, "é" * 50])
    (words, runs) = [[b for b in suffix_tree._counts([pa.RecordBatch.from_arrays([texts], ["text"])]) if b.column("kind")[0].as_py() == k] for k in (0, 1)]
    key = np.concatenate([b.column("key").to_numpy() for b in runs])
    n = np.concatenate([b.column("n").to_numpy() for b in runs])
    assert n.sum() == sum(len(t.as_py().encode()) + 1 for t in texts)
    levels = []
    for d in range(suffix_tree.DEPTH + 1):
        k, c = suffix_tree._added([key % (1 << 8 * (d + 1))], [n])
        levels.append((k, c))
    tree = suffix_tree.Tree.fit(levels, int(n.sum()))
    probs = 10 ** tree.score.reshape(-1, 256).astype(float)
    assert np.allclose(probs.sum(1), 1, atol=1e-4) and tree.size > 5
    # By hand: walk from the last byte backwards while the child exists.
    child = tree.child.reshape(-1, 256)
    for text in ("the cat", "then", "zzz", ""):
        sym = [0xFE] * suffix_tree.DEPTH + list(text.encode()) + [0xFF]
        total = 0.0
        for i in range(suffix_tree.DEPTH, len(sym)):
            at = 0
            for d in range(1, suffix_tree.DEPTH + 1):
                if child[at, sym[i - d]] >= tree.size:
                    break
                at = child[at, sym[i - d]]
            total += float(tree.score.reshape(-1, 256)[at, sym[i]])
        assert abs(total - tree.scores(pa.array([text]))[0]) < 1e-4


def test_suffix_tree_in_tables_equals_the_plain_one(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix_tree, "BLOCK", 4000)
    listed = [*rows(), *[(9000 + i, f"id {i} " + "zyx wvu tsr " * 3, None, None, 0, 0, "", 0, "", 0) for i in range(30)]]
    own = [r[1] or "" for r in listed if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    (runs,) = [[b for b in suffix_tree._counts([pa.RecordBatch.from_arrays([pa.array(own)], ["text"])]) if b.column("kind")[0].as_py() == 1]]
    key, n = (np.concatenate([b.column(c).to_numpy() for b in runs]) for c in ("key", "n"))
    levels = []
    for d in range(suffix_tree.DEPTH + 1):
        k, c = suffix_tree._added([key % (1 << 8 * (d + 1))], [n])
        _, at, m = np.unique(k >> 8, return_inverse=True, return_counts=True)
        often = (np.bincount(at, c)[at] >= suffix_tree.LEAST_COUNT) | (d == 0)
        levels.append((k[often], c[often]))
    tree = suffix_tree.Tree.fit(levels, int(n.sum()))
    want = sorted((str(r[0]), float(tree.scores(pa.array([r[1] or ""]))[0])) for r in listed)
    got = sorted((str(r.doc_id), r.score) for r in suffix_tree.lm_scores(frame(spark, listed)).collect())
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose([x[1] for x in got], [x[1] for x in want], rtol=1e-5, atol=1e-3)


def test_suffix_tree_keeps_contexts_at_any_share(spark):
    # 40 occurrences tell a context in 3,000 symbols and in 300 million alike.
    common = [(i, i, 0) for i in range(97, 100)]
    q = 0xFE
    def run(*symbols):
        code = 0
        for s in ([q] * suffix_tree.DEPTH + list(symbols))[-suffix_tree.DEPTH - 1 :]:
            code = code << 8 | s
        return code
    gained = []
    for many in (1_000, 100_000_000):
        runs = [(run(98, 97), 40), (run(99, 97), 0), *[(run(a), many) for a, _, _ in common]]
        gained.append({r.key: r.score for r in suffix_tree.run_scores(spark.createDataFrame(runs, "key long, n long")).collect()})
    assert all(g[run(98, 97)] > -0.5 and g[run(99, 97)] < -0.4 for g in gained)
    assert gained[1][run(98, 97)] > gained[1][run(99, 97)] + 0.1


def test_header_and_footer_of_a_host(spark):
    listed = [(i, f"The header of all pages\nown words of page {i}: " + " ".join(f"w{i}x{j}" for j in range(60)) + "\nThe footer of all pages", "en", "one", 0, 0, "", 0, "", 0) for i in range(500)]
    docs = frame(spark, listed)
    assert quality_rules.quality_rules(docs).where("n_removed_lines = 2 and kept").count() == 500
    assert quality_rules.keep(spark, docs).where("text like 'own words%' and text not like '%footer%'").count() == 500


def test_quality_counts_distinct_documents_of_a_host(spark):
    # Ten shared lines and one own: the smallest hash is nearly always a shared one.
    shared = "\n".join(f"Shared line number {i} of the host's frame, on each of its pages." for i in range(10))
    listed = [(i, f"{shared}\nOwn  line {i}", "en", "hot", 0, 0, "", 0, "", 0) for i in range(100)]
    listed += [(200 + i, listed[0][1], "en", "cold", 0, 0, "", 0, "", 0) for i in range(100)]
    listed += [(400 + i, f"White {' ' * (1 + i % 3)}space between\n{' '.join(str(i * 100 + j) for j in range(60))}", "en", "gaps", 0, 0, "", 0, "", 0) for i in range(30)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, listed)).collect()}
    assert all(got[i].n_removed_lines == 10 and got[i].depleted for i in range(100))
    assert all(got[200 + i].n_removed_lines == 0 for i in range(100))
    assert all(got[400 + i].n_removed_lines == 1 for i in range(30))


def brute_near_items(text, bench):
    """Items with an aligned window that has at most two differing words and two equal ones, and with no exact one."""
    w = _W.findall(ascii_lower(text))
    for item, t in bench:
        b = _W.findall(ascii_lower(t))
        n = min(13, len(b))
        most = max(0, min(2, n - 2))
        best = min((sum(not (0 <= g + i + j < len(w) and w[g + i + j] == b[i + j]) for j in range(n)) for g in range(-len(b), len(w) + 1) for i in range(len(b) - n + 1)), default=99)
        if 0 < best <= most:
            yield item


def test_proximity_against_brute_force(spark):
    import itertools

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    bench = [(1, " ".join(item)), (2, "one two three"), (3, "p q r s t u v"), (4, "solo"), (5, " ".join(item) + " xi omikron pi rho")]
    texts = []
    for n in (1, 2, 3):
        for at in itertools.combinations(range(13), n):
            texts.append("so it is " + " ".join("other" if i in at else x for i, x in enumerate(item)) + " it was")
    texts += ["one two four", "one four five", "p q x s t y v", "p q x s z y v", " ".join(item[2:]), " ".join(item[3:]), "solo", "xi " + bench[4][1]]
    docs = frame(spark, [(i, t, None, None, 0, 0, "", 0, "", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r.n_near for r in decontaminate.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {i: len(list(brute_near_items(t, bench))) for i, t in enumerate(texts)}
    assert sum(v > 0 for v in got.values()) >= 91
