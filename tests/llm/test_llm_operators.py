"""Each operator against a brute-force version on small tables, with odd rows."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opinio.llm import chat, decontaminate, lines, minhash, mixing, pii, quality, queries, suffix, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, vocabulary=40):
    return " ".join(rng.choice("aeiou") + rng.choice("klmnprst") + str(rng.randrange(vocabulary)) for _ in range(n))


def near_copies(seed=5):
    """Texts with exact copies, near copies, shared passages and unrelated ones."""
    rng, rows = random.Random(seed), []
    passage = prose(rng, 70, 400)
    for i in range(60):
        base = prose(rng, rng.randrange(5, 160), 400).split()
        kind = i % 5
        if rows and kind in (1, 2):
            base = rng.choice(rows)[1].split()
            if kind == 2:
                for _ in range(max(1, len(base) // 40)):
                    base[rng.randrange(len(base))] = "changed"
        if kind == 3:
            at = rng.randrange(len(base))
            base[at:at] = passage.split()
        rows.append((i, " ".join(base)))
    return rows


# ---- 1 mixing

def test_mixing_targets_and_nested_cuts(docs_of, odd_rows):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 30)), rng.choice(["b", "a", None, "c", "d"])) for i in range(400)] + odd_rows
    docs = docs_of(rows)
    got = mixing.mix_sources(docs, keep=("doc_id", "text", "source")).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, capped, budget = {}, set(), 1.5 * sum(size.values())
    while True:  # share, stop at the caps, share the excess again
        open_ = [s for s in names if s not in capped]
        left = budget - sum(2 * size[s] for s in capped)
        want = {s: 2 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        above = {s for s in open_ if want[s] > 2 * size[s]}
        if not above:
            break
        capped |= above
    for s in names:
        assert target[s][0] == pytest.approx(want[s]) and target[s][1] == size[s]
        assert abs(taken[s] - want[s]) <= 60
    smaller = {(r.doc_id, r.text): r.taken for r in mixing.mix_sources(docs, keep=("doc_id", "text"), budget_share=0.5).collect()}
    assert all(smaller[r.doc_id, r.text] <= r.taken for r in got)  # budgets nest
    assert mixing.mix_sources(docs.limit(0), keep=("doc_id",)).count() == 0


# ---- 2 personal data

def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_pii_base_spans_on_random_strings():
    rng = random.Random(2)
    parts = ["a.b@c.d", "@", "x@y", "1.2.3.4", "256.1.1.1", "0012.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (988) 555-2485",
             "+", " ", "-", ".", "é", "12", "@a.b@c.d_e@f.g", "%", "\n", "+12", ")))", "1.2.3.4.5.6.7.8", "378282246310005"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text), text


def test_pii_validators_context_and_odd_rows(docs_of, odd_rows):
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("account GB82 WEST 1234 5698 7654 32 now") == ["iban"] and kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    got = pii.detect(docs_of([*odd_rows, (90, "a@b.cc")]), keep=("doc_id", "pii")[:1]).collect()
    assert len(got) == len(odd_rows) + 1 and sum(len(r.pii) for r in got) == 1
    for long in ("a" * 200_000, "1" * 200_000, "@" * 200_000, "1." * 100_000, "+1" + ")" * 200_000):
        assert isinstance(pii.find_spans(long), list)  # linear


# ---- 3 archives

def test_warc_round_trip(spark, tmp_path):
    nasty = "WARC/1.1\r\nWARC-Type: x\r\n\r\nbody\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://B.example/x", "<p>é</p>"), (2, "http://a.example/", nasty), (3, None, None), (4, "", ""),
             (5, "http://a.example/\r\nq", "<p>é</p>"), (None, "http://a.example/", "<p>é</p>"), (6, "http://a.example/", nasty),
             (7, "http://a.example/7", "\r\n\r\n"), (8, "http://a.example/8", "x" * 200_000), (8, "http://a.example/8", "x" * 200_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_records(df.repartition(3)), path)
    read = warc.read_archives(spark, path)
    leader = defaultdict(list)
    for p, _, h in pages:
        leader[h or ""].append(p)
    want = Counter()
    for p, _, h in pages:
        raw, best = (h or "").encode(), max((x for x in leader[h or ""] if x is not None), default=None)
        revisit = best is not None and p != best
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
             best if revisit else None] += 1
    index = warc.merge_index(read).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == want
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in index]
    assert keys == sorted(keys)
    back = {r.page_id: bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    assert back[6] == nasty and back[7] == "\r\n\r\n" and back[4] == ""
    empty = str(tmp_path / "e")
    warc.write_archives(warc.plan_records(df.limit(0)), empty)
    assert warc.merge_index(warc.read_archives(spark, empty)).count() == 0


def test_the_index_reads_the_archives_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(key):
        read.add(1)
        return key

    captures = spark.createDataFrame([(f"k{i}", 0, i, "response", None, 0, "", "r", i) for i in range(60)],
                                     warc.INDEX + ", run string, seq long")
    assert len(warc.merge_index(captures.withColumn("url_key", seen("url_key")), rows=60).collect()) == 60
    assert read.value == 60


def test_warc_key_ranges_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 2)
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    ranges = -(-pages // 2)
    assert ranges > int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = queries.op3_warc(spark, sf)
    assert index.rdd.getNumPartitions() == ranges and index.count() == pages
    captures = spark.createDataFrame([(f"k{i}", 0, i, "response", None, 0, "", "r", i) for i in range(60)],
                                     warc.INDEX + ", run string, seq long")
    assert warc.merge_index(captures).rdd.getNumPartitions() == 30


def test_loser_tree_merges():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(20), None) for _ in range(rng.randrange(9))) for _ in range(k)] if k else []
        assert list(warc.LoserTree(runs)) == sorted((x for r in runs for x in r), key=lambda x: x[0])


# ---- 4 near-duplicates

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_minhash_components(docs_of, odd_rows):
    rows = near_copies() + [(d and 100 + d, t) for d, t in odd_rows]
    got = minhash.near_duplicates(docs_of(rows)).collect()
    want = Counter((d, n, c, d == c) for d, n, c in brute_components(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_minhash_without_further_hub_rounds(docs_of, monkeypatch):
    """Chains whose ends are far apart, and small blocks: the block comparison finds the rest."""
    monkeypatch.setattr(minhash, "LEAST_MERGED", 2.0)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rng, rows = random.Random(21), []
    for family in range(3):
        words = prose(rng, 100, 500).split()
        for step in range(8):  # each a few words further from the first
            words[rng.randrange(100)] = f"new{family}{step}"
            rows.append((len(rows), " ".join(words)))
    got = minhash.near_duplicates(docs_of(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, c) for d, _, c in brute_components(rows)}


def test_minhash_chain_and_pruning():
    least = minhash.least_matches()
    assert all(a < b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.75 * minhash.HASHES


# ---- 5 line chunks

def test_line_chunks(docs_of, odd_rows):
    rng = random.Random(4)
    shared = [prose(rng, 30) for _ in range(12)]
    rows = [(i, "\n".join([prose(rng, 6) for _ in range(rng.randrange(5))] + shared[:rng.randrange(13)] + [prose(rng, 5)]))
            for i in range(30)] + [(100 + (d or 0), t) for d, t in odd_rows[:4]] + [(200, shared[0]), (201, "")]
    docs = docs_of(rows)
    found = defaultdict(list)
    for c in lines.chunks(docs).collect():
        found[c.doc].append(c)
    seen, want, removed = set(), {}, 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        left = []
        for c in sorted(found[d], key=lambda c: c.pos):
            counts = c.n_lines > 1 or len(WORD.findall(c.chunk)) >= lines.LONG_LINE_WORDS
            if counts and c.chunk in seen:
                removed += c.n_lines
            else:
                left.append(c.chunk)
            seen |= {c.chunk} if counts else set()
        want[d] = None if t is None else "\n".join(left)
        assert t is None or "\n".join(c.chunk for c in sorted(found[d], key=lambda c: c.pos)) == t
    out = lines.dedup_lines(docs)
    assert {r.doc_id: r.text for r in out.collect()} == want and removed > 40
    assert out.columns == [*docs.columns, "n_lines_removed"]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_line_borders_shift_with_the_text(docs_of):
    rng = random.Random(9)
    passage = [prose(rng, 8) for _ in range(40)]
    cut = lambda head: [c.chunk for c in lines.chunks(docs_of([(1, "\n".join(head + passage))])).orderBy("pos").collect()]
    assert cut([])[3:] == cut(["another line", "and one more", "third"])[-len(cut([])[3:]):]


def test_planted_passages_between_different_neighbours(docs_of, odd_rows):
    rng = random.Random(17)
    fresh = lambda: " ".join(f"own{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 12)))
    split = {1: [60], 2: [40, 20], 3: [24, 3, 30]}  # words of each line
    planted = {k: [[prose(rng, n, 10**6) for n in split[k]] for _ in range(20)] for k in split}
    rows = []
    for turn in range(2):
        for k, some in planted.items():
            for j, p in enumerate(some):
                head, tail = [fresh() for _ in range(rng.randrange(4))], [fresh() for _ in range(rng.randrange(4))]
                rows.append((1000 * turn + 100 * k + j, "\n".join(head + p + tail)))
    got = {r.doc_id: (r.text or "").split("\n") for r in lines.dedup_passages(docs_of(rows)).collect()}
    whole = {d: t.split("\n") for d, t in rows}
    for k, some in planted.items():
        for j, p in enumerate(some):
            d = 100 * k + j
            assert got[d] == whole[d]
            assert got[1000 + d] == ([x for x in whole[1000 + d] if x not in p] or [""])

    # Brute force: every run of lines from 25 words on that stands at a smaller place goes.
    pool = [prose(rng, n) for n in (3, 5, 9, 9, 14, 30, 26)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    rows += [(100 + (d or 0), t) for d, t in odd_rows[:4]]
    found, drop, runs = defaultdict(list), defaultdict(set), {}
    for c in lines.chunks(docs_of(rows)).collect():
        if c.n_lines > 1 or len(WORD.findall(c.chunk)) >= lines.LONG_LINE_WORDS:
            found[c.doc].append((c.first, c.n_lines))
    for d, t in rows:
        ls = (t or "").split("\n")
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = "\n".join(ls[a:b])
                long = len(WORD.findall(run)) >= lines.LONG_LINE_WORDS and WORD.search(ls[a]) and WORD.search(ls[b - 1])
                if t is not None and (long or (a, b - a) in found[d]):
                    if run in runs:
                        drop[d] |= set(range(a, b))
                    runs.setdefault(run, d)
    out = lines.dedup_passages(docs_of(rows)).collect()
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[d]) for d, t in rows}
    assert {r.doc_id: r.text for r in out} == want
    assert {r.doc_id: r.n_lines_removed for r in out} == {d: len(drop[d]) for d, _ in rows}
    assert sum(map(len, drop.values())) > 40 and lines.dedup_passages(docs_of([])).count() == 0


# ---- 6 quality

def measured(text):
    text = text or ""
    w, grams = WORD.findall(text), None
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice, kept = Counter(grams), [x for x in text.split("\n") if WORD.search(x)]
    covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(kept) - len(set(kept)), len(covered))


def test_quality_ledger(docs_of, odd_rows):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(90), rng.choice([1, 2, 30]))) for i in range(60)] + odd_rows + [(70, "a b c a b c a"), (71, "#! 😀 é\n#! 😀 é")]
    book = quality.ledger(quality.measure(docs_of(rows), keep=("doc_id",)), keep=("doc_id",)).cache()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == Counter((d, *measured(t)) for d, t in rows)
    kept = book.where(quality.passes(quality.PRODUCTION)).count()
    table = {r.rule: r for r in quality.ablations(book).collect()}
    for rule, r in table.items():
        assert r.n_failed == book.where(F.col("failed").bitwiseAND(quality.BITS[rule]) != 0).count()
        assert r.n_kept_without == kept + r.n_only
    base = book.where(quality.passes(quality.BASE)).count()
    assert base == sum(n >= 50 and 100 * c <= 50 * n for n, _, _, _, c in (measured(t) for _, t in rows))
    assert quality.measure(docs_of([])).count() == 0


def test_quality_tells_apart_windows_that_share_digest_bits(docs_of, monkeypatch):
    """With one digest bit left every window collides: the exact path must decide."""
    rows = [(1, " ".join(f"w{i}" for i in range(80)) + " w1 w2 w3 w4")]
    real = F.bin
    monkeypatch.setattr(quality.F, "bin", lambda c: F.lit("1" * 62))
    got = quality.measure(docs_of(rows)).first()
    monkeypatch.setattr(quality.F, "bin", real)
    assert got.n_repeat_words == measured(rows[0][1])[4] == 8


def test_native_operators_have_no_python_in_their_plans(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    for df in (quality.ledger(quality.measure(docs)), lines.dedup_lines(docs), mixing.mix_sources(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- 7 toxicity

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng, terms = random.Random(7), ["abcde", "abd", "bcdea", "eeeeee", "dab*", "cadeb*"]
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(4000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randrange(9)))
        best = None
        for t in terms:
            letters = t.removesuffix("*")
            cuts = range(len(word) + 1) if t.endswith("*") else [len(word)]
            d = min(distance(letters, word[:c]) for c in cuts)
            if d <= toxicity.allowed_edits(letters):
                best = min(best, d) if best is not None else d
        hit = automaton.match(word)
        assert (hit[1] if hit else None) == best, word


def test_quoted_context():
    text = 'he wrote "idiot" there'
    assert toxicity.quoted(text, 10, 15) and not toxicity.quoted("you idiot there", 4, 9)


def test_toxicity_learns_and_holds_out(spark, docs_of, odd_rows):
    rng, rows, labels = random.Random(8), [], []
    for i in range(1500):
        text, toxic = prose(rng, 60), int(rng.random() < 0.15)
        if toxic:
            w = text.split()
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(60)] = rng.choice(["grobian", "lump" + rng.choice("xyzvw"), "lump" + rng.choice("xyzvw") + "en"])
            text = " ".join(w)
        rows.append((1000 + i, text))
        labels.append((1000 + i, 1, toxic))
    docs = docs_of(rows + odd_rows)
    table = spark.createDataFrame([*labels, (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, table)
    assert "grobian" in lexicon.terms and any(t.startswith("lump") for t in lexicon.terms)
    scores = toxicity.score_texts(docs, lexicon, keep=("doc_id", "text"))
    held = scores.join(table, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(held) > 150 and sum((r.score >= 0.5) == (r.toxic == 1) for r in held) >= 0.97 * len(held)
    assert scores.count() == len(rows) + len(odd_rows) and all(0 <= r.score < 0.5 for r in scores.where("text IS NULL").collect())
    assert lexicon.scorer().score("so ein grobjan und lumpx und lumpy " + prose(rng, 30)) >= 0.5  # misspelled
    nothing = toxicity.learn(docs, table.limit(0))
    assert toxicity.score_texts(docs, nothing).agg(F.max("score")).first()[0] == 0.0


# ---- 8 chat

def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\", "\\<|turn|>", "<|end|>", "<", "|end|>", "", None, "x\n<<SYS>> \\\\n 😀", "$1 \\$"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in
            enumerate(zip(["user", "assistant", None, "we\\ird\n<|end|>", "assistant"] * 2, texts, strict=True))]
    df = spark.createDataFrame(rows + [(2, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    made = chat.conversations(chat.linear_trees(df))
    got = {r.tree: (r.turns, r.learned) for r in made.select(
        "tree", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    for c in (1, None):
        assert [(t.role, t.text) for t in got[c][0]] == [(r or "", x or "") for i, _, r, x in rows if i == c]
        assert got[c][1] == "".join(x or "" for i, _, r, x in rows if i == c and r == "assistant")
    assert len(got[2][0]) == 2
    assert chat.conversations(chat.linear_trees(df.limit(0))).count() == 0


def test_reply_tree_paths_and_ranking(spark):
    rng, nodes, parent = random.Random(10), [], {}
    for i in range(120):
        parent[i] = None if i % 40 == 0 else (i - 1 if rng.random() < 0.6 else rng.randrange(i // 40 * 40, i))
        nodes.append((i // 40, i, parent[i], "user", f"t{i}", rng.random()))
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    leaves = set(parent) - set(parent.values())
    want = {}
    for leaf in leaves:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        want[leaf] = path[::-1]
    made = chat.conversations(df, per_tree=1000).select("tree", "leaf", "score", chat.parse(F.col("formatted")).alias("p")).collect()
    assert {r.leaf: [int(t.text[1:]) for t in r.p] for r in made} == want
    best = {r.tree: r.leaf for r in chat.conversations(df).collect()}
    mean = lambda leaf: sum(nodes[i][5] for i in want[leaf]) / len(want[leaf])
    assert best == {t: max((x for x in leaves if x // 40 == t), key=mean) for t in range(3)}


# ---- 9 decontamination

def hits_of(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        m = min(window, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j:j + m] == b[i:i + m]:
                    hit |= set(range(j, j + m))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [10 ** 6, 200])
def test_decontamination(spark, docs_of, odd_rows, block_bytes):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(1, 30), 2)) for i in range(25)] + [(3, "the same id"), (None, "Über, straße"), (90, None), (91, "!!")]
    rows = [(i, prose(rng, 40, 2).upper() + " " + (rng.choice(items)[1] or "") + " über STRASSE über-straße " + prose(rng, 5, 2)) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs_of(rows + odd_rows), benchmark, keep=("doc_id", "text", "items"), block_bytes=block_bytes).collect()
    assert len(got) == len(rows) + len(odd_rows)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == hits_of(r.text, items, 13)
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert decontaminate.decontaminate(docs_of(odd_rows), benchmark.limit(0)).where("contaminated").count() == 0


# ---- 10 repeated strings

def cut_bytes(rows):
    first = {}
    order = lambda d: (d is None, d or 0)
    for d, t in sorted(rows, key=lambda r: order(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], order(d))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < order(d):
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group", [suffix.GROUP, 0])
def test_repeated_strings(docs_of, odd_rows, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "SLICE", 4096)
    rng = random.Random(12)
    rows = near_copies() + [(d and 100 + d, (t or "")[:20_000]) for d, t in odd_rows]
    rows += [(200, "ab" * 3000), (201, "x" + "ab" * 400), (202, "é" * 40), (203, "é" * 41), (204, prose(rng, 3000)), (204, prose(rng, 2000))]
    got = suffix.remove_repeats(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == cut_bytes(rows)
    assert suffix.remove_repeats(docs_of([])).count() == 0


# ---- kernels

def test_word_kernel(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tokens, "SLICE_BYTES", 64)
    rng = random.Random(13)
    texts = ["".join(rng.choice("abAB é\n\t\x0b.0") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "z" * 500]
    raw, offsets = tokens.text_bytes(pa.array(texts))
    known = {}
    for is_word, rx in ((tokens.white_space(), WORD), (tokens.alphanumeric(), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        for lo, hi in tokens.slices(offsets):
            w = tokens.Words(raw, offsets, lo, hi, is_word)
            for r in range(hi - lo):
                want = rx.findall((texts[lo + r] or "").translate(LOWER))
                at = range(int(w.first[r]), int(w.first[r + 1]))
                assert [w.text(i).decode() for i in at] == want
                for i, word in zip(at, want, strict=True):
                    assert known.setdefault(word, int(w.digest[i])) == int(w.digest[i])
    assert len(set(known.values())) == len(known)
