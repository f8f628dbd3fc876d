"""The pipeline stage by stage against brute-force versions, on the smallest tables."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as P
from opinio.llm import lines, toxicity
from test_llm_operators import LOWER, WORD, brute_components, hits_of, near_copies, prose

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before = rows(docs)

    clean = P.drop_toxic(spark, docs, SF).cache()
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = lexicon.scorer()
    assert clean.columns == list(P.COLUMNS)
    assert set(rows(clean)) == {i for i, r in before.items() if scorer.score(r.text) < 0.5}

    cut = P.dedup_lines(spark, clean, SF).cache()
    found, first, want = {}, {}, {}
    for c in lines.chunks(clean).collect():
        if c.n_lines > 1 or len(WORD.findall(c.chunk)) >= lines.LONG_LINE_WORDS:
            found.setdefault(c.doc, []).append((c.first, c.first + c.n_lines, c.chunk))
    for i, r in sorted(rows(clean).items()):  # every shortest run of lines that reaches the words, from and up to each line
        ls = (r.text or "").split("\n")
        size = [len(WORD.findall(x)) for x in ls]
        for k in (k for k, n in enumerate(size) if n):
            ends = [z for z in range(k + 1, len(ls) + 1) if sum(size[k:z]) >= lines.LONG_LINE_WORDS]
            starts = [a for a in range(k, -1, -1) if sum(size[a:k + 1]) >= lines.LONG_LINE_WORDS]
            found.setdefault(i, []).extend([(k, z, "\n".join(ls[k:z])) for z in ends[:1]] + [(a, k + 1, "\n".join(ls[a:k + 1])) for a in starts[:1]])
        for a, _, run in found.get(i, []):
            first[run] = min(first.get(run, (i, a)), (i, a))
    n_gone = 0
    for i, r in sorted(rows(clean).items()):
        gone = {x for a, z, run in found.get(i, []) if first[run] != (i, a) for x in range(a, z)}
        n_gone += len(gone)
        text = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone)
        if not (gone and not WORD.search(text)):
            want[i] = text
    assert n_gone > 100
    assert cut.columns == list(P.COLUMNS) and {i: r.text for i, r in rows(cut).items()} == want

    single = P.dedup_near(spark, cut, SF).cache()
    kept = {d for d, _, c in brute_components(sorted(want.items())) if d == c}
    assert single.columns == list(P.COLUMNS) and set(rows(single)) == kept

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    safe = P.decontaminate(spark, single, SF).cache()

    def contaminated(text):
        n, hit, _ = hits_of(text, items, 13) if any(w in (text or "").lower() for w in heads) else (1, 0, [])
        return hit > 0 and 20 * hit >= n
    heads = {w for _, t in items for w in (t or "").lower().split()[:40]}
    some = sorted(kept)[:40]
    assert safe.columns == list(P.COLUMNS)
    assert {i for i in some if i in rows(safe)} == {i for i in some if not contaminated(want[i])}

    mixed = P.mix(spark, safe, SF).collect()
    assert {r.doc_id for r in mixed} <= set(rows(safe)) and all(r.taken > 0 for r in mixed)
    assert Counter((r.doc_id, r.taken) for r in P.run(spark, SF).collect()) == Counter((r.doc_id, r.taken) for r in mixed)


def test_near_dedup_goes_by_rows(spark, docs_of):
    """Null and repeated ids: one row of each group stays, and no other text is lost."""
    rng = random.Random(31)
    text, clean, other, alone = (prose(rng, 80, 5000) for _ in range(4))
    near = lambda t, w: f"{t} {w}"
    rows = [(1, text), (None, near(text, "x")),         # a near copy without id goes
            (2, clean), (2, near(text, "y")),           # of two texts under one id only the near copy goes
            (3, other), (3, other), (3, other),         # of equal rows one stays
            (4, near(alone, "x")), (4, near(alone, "y")),   # near copies under one id
            (None, "a b c"), (None, "a b c"), (None, "d e f"),
            (None, None), (5, None), (6, " "), (7, " "), (8, ""), (8, "")]
    got = Counter((r.doc_id, r.text) for r in P.dedup_near(spark, docs_of(rows), "").collect())
    four = next(t for d, t in got if d == 4)
    assert four in (near(alone, "x"), near(alone, "y"))
    assert got == Counter([(1, text), (2, clean), (3, other), (4, four), (None, "a b c"), (None, "d e f"),
                           (None, None), (5, None), (6, " "), (7, " "), (8, "")])
    unique = near_copies()
    left = P.dedup_near(spark, docs_of(unique), "").select(*P.COLUMNS)
    assert {r.doc_id for r in left.collect()} == {d for d, _, c in brute_components(unique) if d == c}
    assert left.columns == list(P.COLUMNS) and P.dedup_near(spark, docs_of([]), "").count() == 0


def windows_of(text, sizes):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + m]) for m in sizes(len(w)) for i in range(len(w) - m + 1)}


def mix_of(rows):
    """``(doc_id, taken)`` of ``(doc_id, text, source)`` rows with distinct ids and texts."""
    size, words = Counter(), {}
    for d, t, s in rows:
        words[d] = len(WORD.findall(t or ""))
        size[s] += words[d]
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:  # share, stop at the caps, share the excess again
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        share = left / max(1, sum(weight[s] for s in names if s not in capped))
        above = {s for s in names if s not in capped and share * weight[s] > 2 * size[s]}
        if not above:
            break
        capped |= above
    taken = {}
    for s in names:
        target = 2.0 * size[s] if s in capped else share * weight[s]
        copies = int(target // size[s]) if size[s] else 0
        rest, upto, cut = target - copies * size[s], 0, 0
        key = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
        hashes = {d: key(d, t) for d, t, own in rows if own == s}
        for d in sorted(hashes, key=hashes.get):
            if upto + words[d] > rest:  # the budget ends in this document: taken if that is nearer
                cut = hashes[d] + (upto + words[d] - rest < rest - upto)
                break
            upto += words[d]
        taken |= {d: words[d] * (copies + (h < cut)) for d, h in hashes.items()}
    return {(d, n) for d, n in taken.items() if n > 0}


def test_pipeline_decontamination_and_mix_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shape = [(i, t, windows_of(t, lambda n: [min(13, n)] if n else [])) for i, t in items]
    sizes = {len(w) for *_, ws in shape for w in ws}
    clean = set()
    for d, r in rows.items():
        own = windows_of(r.text, lambda n: sizes)
        n, hit, _ = hits_of(r.text, [(i, t) for i, t, ws in shape if ws & own], 13)
        clean |= {d} if not hit or 20 * hit < n else set()
    safe = P.decontaminate(spark, docs, SF).cache()
    assert [r.doc_id for r in safe.orderBy("doc_id").collect()] == sorted(clean) and len(clean) < len(rows)
    mixed = P.mix(spark, safe, SF).collect()
    assert {(r.doc_id, r.taken) for r in mixed} == mix_of([(d, rows[d].text, rows[d].source) for d in clean])
    assert len(mixed) == len({r.doc_id for r in mixed}) < len(clean)
