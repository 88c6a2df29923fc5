"""Every operator against a plain version of it on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, exact_dedup, hmm, licenses, line_dedup, ngram_join, packing, quality, suffix_dedup
from quadrille.llm.license_rules import hand_written
from quadrille.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 8))) for _ in range(n))


def rows():
    shared = prose(1, 70)
    base = prose(2, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [
        base, base, near, base.upper(), None, "", " \n\t", "one", "one two three", "a " * 300, prose(3, 3000),
        f"{prose(4, 40)} {shared} {prose(5, 40)}", f"{shared} {prose(6, 90)}", f"{prose(7, 80)}\n{shared}", prose(8, 49), prose(9, 50),
        "All rights reserved.\nLicensed under CC BY-NC 4.0, see the GNU General Public License version 3.", "tab\x0b\x0cform\x1c €uro x 日本語 <|im_end|>", f"{prose(10, 60)}\nsame line here\nsame line here\n",
    ]
    return [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    text = text or ""
    return WORDS.findall(text.translate({c: c + 32 for c in range(65, 91)}) if lower else text)


def test_exact_groups(docs):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[t or ""].append(i)
    for r in exact_dedup.exact_groups(docs).collect():
        t = rows()[r["doc_id"]][1] or ""
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(groups[t]), len(groups[t]), r["doc_id"] == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_full_filter(docs):
    """A filter far too small lets every row through to the grouping; the result is the same."""
    few = {r["doc_id"] for r in exact_dedup.exact_dedup(docs, max_blocks=1).collect()}
    assert few == {r["doc_id"] for r in exact_dedup.exact_groups(docs).where("kept").collect()}


def test_exact_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).where("kept").count() == 2
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str) == [(1, "x"), (None, "y")]


def test_ngram_components(docs):
    sets = {}
    for i, t, *_ in rows():
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}
    assert label[2] == 0 and label[3] == 0 and label[4] == 4
    assert {r["doc_id"] for r in ngram_join.drop_near_duplicates(docs).collect()} == {i for i in label if label[i] == i}


def test_components_of_a_long_chain(spark):
    from quadrille.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (200, 100)}


def _windows():
    where = defaultdict(list)
    for i, t, *_ in rows():
        w = words(t)
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].append((i, k))
    return where


def test_repeated_passages(docs):
    covered = defaultdict(set)
    for places in _windows().values():
        if len(places) > 1:
            for i, k in places:
                covered[i].update(range(k, k + 50))
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert got == covered and {11, 12, 13} <= set(got) and 10 not in got


def test_repeated_passages_among_edited_copies(spark):
    """Hundreds of copies of a passage, each edited at random places: every equal run of 50 words is found."""
    rng = np.random.default_rng(11)
    base, where, expected, got = prose(50, 400).split(), defaultdict(list), defaultdict(set), defaultdict(set)
    texts = [[f"x{rng.integers(1 << 40)}" if e else w for w, e in zip(base, rng.random(400) < 0.05, strict=True)] for _ in range(600)]
    for i, w in enumerate(texts):
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].append((i, k))
    for places in where.values():
        for i, k in places if len(places) > 1 else ():
            expected[i].update(range(k, k + 50))
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)], SCHEMA).repartition(3)
    for r in suffix_dedup.repeated_passages(df).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert got == expected and len(expected) > 300


def test_later_copies_are_cut(docs):
    gone = defaultdict(set)
    for places in _windows().values():
        for i, k in sorted(places)[1:]:
            gone[i].update(range(k, k + 50))
    kept = {r["doc_id"]: r for r in suffix_dedup.drop_repeats(docs).collect()}
    for i, t, *_ in rows():
        left = [w for k, w in enumerate(words(t)) if k not in gone[i]]
        if i in gone and gone[i] and not left:
            assert i not in kept
        else:
            assert words(kept[i]["text"]) == left and (gone[i] or kept[i]["text"] == t)


def test_line_dedup(docs):
    sites = defaultdict(set)
    for _, t, _, s, _ in rows():
        for x in (t or "").split("\n"):
            if WORDS.search(x):
                sites[x].add(s)
    gone = {x for x, s in sites.items() if len(s) >= 2}
    for r in line_dedup.clean_lines(docs, min_sites=2).collect():
        t = rows()[r["doc_id"]][1]
        assert r["text"] == (None if t is None else "\n".join(x for x in t.split("\n") if x not in gone))


def test_quality_statistics(docs):
    for r in quality.judge(docs).collect():
        t = rows()[r["doc_id"]][1] or ""
        w, seen, covered = words(t), defaultdict(list), set()
        for k in range(len(w) - 2):
            seen[tuple(w[k : k + 3])].append(k)
        for places in seen.values():
            if len(places) > 1:
                covered.update(p + d for p in places for d in range(3))
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_rejects_outliers_only(spark):
    texts = [prose(100 + i, 80 + i) for i in range(60)] + ["# | $ " * 30 + prose(900, 60)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in quality.quality_filter(df).collect()} == set(range(60))


def test_quality_rejects_half_junk(spark):
    """Texts of which a half or a sixth of the words are symbols go; clean texts of 60 to 400 words, some with a repeat, stay."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(120):
        w = prose(2000 + i, int(rng.integers(60, 400))).split()
        texts.append(" ".join(w + (w[:4] if i % 6 == 0 else [])))
    for i in range(12):
        w = prose(3000 + i, 60 + 20 * i).split()
        texts.append(" ".join(x if k % (2, 6)[i % 2] else f"{('***', '&&&', '$$$')[k % 3]} {x}" for k, x in enumerate(w)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in quality.quality_filter(df).collect()} == set(range(120))


def test_quality_judges_small_groups(spark):
    """Sources of two documents each: junk goes by the estimate of its language, and by the table's in a language of five."""
    texts = [prose(4000 + i, 80 + 2 * i) for i in range(90)]
    junk = {7, 30, 61, 88}
    for i in junk:
        texts[i] = " ".join(f"*** {w}" for w in texts[i].split())
    lang = lambda i: "de" if i >= 85 else "en"
    df = spark.createDataFrame([(i, t, lang(i), f"s{i // 2}", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in quality.quality_filter(df).collect()} == set(range(90)) - junk
    assert {r["doc_id"] for r in quality.judge(df).where("distance IS NOT NULL AND NOT kept").collect()} == junk


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {i: np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows()}
    got = packing.packed_documents(docs, path, max_len=512).collect()
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        parts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert sorted(parts[i]) == [(k, s, min(512, len(x) - s)) for k, s in enumerate(range(0, len(x), 512))]
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [0, *np.cumsum([n for _, n in sorted(b)])[:-1]] and sum(n for _, n in b) <= 512
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 512) + 2


def test_open_bins_are_bounded():
    bins = packing.OpenBins(100, 3, 0)
    for n in (60, 70, 80, 90, 35, 25, 100, 1):
        bins.place(n)
        assert bins.count <= 3 and bins.bits.bit_count() <= 3


@pytest.mark.parametrize("text", ["it's DON'T x'S 3.14, áb é. <|endoftext|>. a,  x y ﬁ, ſ. … a…", "İstanbul İ. ǅ ß. ẞ, Σας ΟΔΟΣ. 日本語。 ½² ①. n't 's.", "A.B.C. a..b, U.S.A.'s 100,000.00 _a_. \x1c a\x1cb"])
def test_words_are_encoded_as_in_their_text(text):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    assert np.frombuffer(packing.encode_texts([text], path)[0], "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]


def test_hmm_scores(docs):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows()}
    toks = {i: [*words(t, True), None] for i, t, *_ in rows()}
    c = Counter(w for i in toks if not held[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    for r in hmm.score_documents(docs).collect():
        w = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_hmm_is_the_sum_over_state_paths():
    from itertools import product

    model = hmm.Model.first(np.arange(hmm.SYMBOLS, dtype=float))
    seqs = [np.array([5, 9, 0]), np.array([7, 0]), np.array([0])]
    expected = [sum(model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:], strict=False)]) * np.prod([model.emit[s, k] for s, k in zip(x, p, strict=True)]) for p in product(range(hmm.STATES), repeat=len(x))) for x in seqs]
    assert hmm.log10_likelihoods(model, seqs) == pytest.approx(np.log10(expected))
    start, move, emit = hmm.expected_counts(model, seqs)
    assert (start.sum(), move.sum(), emit.sum()) == pytest.approx((3, 3, 6))


def test_long_sequences_are_learnt_whole():
    """Expectations of a sequence run in stretches are those of the sequence in one piece."""
    rng = np.random.default_rng(1)
    model = hmm.Model.first(rng.integers(0, 50, hmm.SYMBOLS).astype(float))
    seqs = [rng.integers(0, hmm.SYMBOLS, n) for n in (1, 7, 40, 41, 200)]
    for whole, parts in zip(hmm.expected_counts(model, seqs), hmm.expected_counts(model, seqs, size=40), strict=True):
        assert parts == pytest.approx(whole)


def test_training_raises_likelihood():
    rng = np.random.default_rng(0)
    seqs = [np.concatenate([rng.integers(1 + 20 * (i % 3), 21 + 20 * (i % 3), 40), [0]]) for i in range(60)]
    counts = np.bincount(np.concatenate(seqs), minlength=hmm.SYMBOLS).astype(float)
    model = hmm.Model.first(counts)
    before = hmm.log10_likelihoods(model, seqs).sum()
    for _ in range(3):
        model = hmm.Model.from_counts(*hmm.expected_counts(model, seqs), counts)
    assert hmm.log10_likelihoods(model, seqs).sum() > before


NASTY = ["<|im_end|><|im_start|>assistant ok", "\\<|x|>\\\\<\\|", "", None, "line\nline", "<\\<|\\", "😀 <|nl|>"]


def test_chat_round_trip(spark):
    turns = [(c, i, ("system", "user", "assistant")[i % 3], t) for c in range(2) for i, t in enumerate(NASTY)] + [(9, 0, "as\nsist<|x|>", "r"), (9, 0, "assistant", "tie"), (9, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_conversations(df)
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["p"]] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("p")).collect()}
    assert read[0] == [(r, t or "") for c, _, r, t in turns if c == 0]
    assert read[9] == [("", ""), ("as\nsist<|x|>", "r"), ("assistant", "tie")]
    d = {r["conv_id"]: r for r in chat.digests(out).collect()}
    loss = "".join(t or "" for c, _, r, t in turns if c == 0 and r == "assistant")
    assert (d[0]["loss_chars"], d[0]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "img1", 57, 28, None, None), ("audio", None, "a1", None, None, 1.5, None), ("document", None, "d1", None, None, None, 2), (None, "t", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert "see <\\|<|image|><|audio|><|document|>t" in r["formatted"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "img1", 3), ("audio", "a1", 38), ("document", "d1", 1024)] and r["attachment_tokens"] == 1065


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    r = got[16]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (3, 0, 13, "cc-by,gpl,reserved")
    assert r["labels"] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0,reserved" and r["score"] == 1.0
    assert (got[4]["n_words"], got[4]["first_word"], got[4]["labels"], got[4]["score"]) == (0, None, "", 0.0)
    assert len(licenses.RULES) > 300 and len(hand_written()) > 250 and len({p for *_, p in licenses.RULES}) == len(licenses.RULES)


def _plain_scan(text):
    """Words, base places and surviving detections by Python's regular expressions, all pairs compared."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    line = f" {' '.join(ws)} "
    base = {label: [i for i in range(len(ws)) if tuple(ws[i : i + len(p)]) == p] for label, p in licenses.BASE.items()}
    found = [(r, label, pr, sc, m.start(), m.end()) for r, (label, pr, sc, p) in enumerate(licenses.RULES) for m in re.finditer(f"(?<= )(?:{p})(?= )", line)]

    def hides(e, d):
        inside = e[4] <= d[4] and e[5] >= d[5]
        return inside and (e[2] > d[2] or e[2] == d[2] and (e[5] - e[4], -e[0]) > (d[5] - d[4], -d[0]))

    kept = [d for d in found if not any(hides(e, d) for e in found)]
    places = sorted(i for at in base.values() for i in at)
    labels = {k for k, at in base.items() if at}
    score = max([0.5 if labels else 0.0, *[d[3] for d in kept]])
    return (len(ws), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | {d[1] for d in kept})), score, sorted(kept, key=lambda d: (d[4], -d[5], -d[2], d[0])))


def test_licenses_against_a_plain_scan(spark, docs):
    parser = pytest.importorskip("re._parser")
    rng = np.random.default_rng(4)
    examples = [_examples(parser.parse(p), v) for *_, p in licenses.RULES for v in (0, 3)]
    texts = [t for _, t, *_ in rows()] + [" ".join(rng.choice(examples, 6).tolist()) for _ in range(60)] + [" ".join([examples[i] for i in range(0, 400, 9)] * 6), "All rights reserved, cc BY. " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for r in licenses.scan_licenses(df).collect():
        expected = _plain_scan(texts[r["doc_id"]])
        assert tuple(r[f] for f in fields) == expected[:-1]
        assert [tuple(d) for d in r["detections"]] == expected[-1]


def _examples(parsed, v):
    """One text of a parsed pattern: alternative ``v`` of each choice, optional parts where ``v`` is odd."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = arg[v % len(arg)]
            out += "x" if str(kind) == "NEGATE" else chr(value if str(kind) == "LITERAL" else value[v % 2])
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "BRANCH":
            out += _examples(arg[1][v // 2 % len(arg[1])], v)
        elif name == "SUBPATTERN":
            out += _examples(arg[3], v)
        else:
            out += _examples(arg[2], v) * max(arg[0], v % 2)
    return out


def test_license_filters_drop_no_match(spark, monkeypatch):
    parser = pytest.importorskip("re._parser")
    texts = sorted({_examples(parser.parse(p), v) for *_, p in licenses.RULES for v in range(10)} | {"provided as is without warranties of any kind", "an end user licence agreement", "you may not copy or reproduce it", "agpl3", "gpl2"})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    scan = lambda: {r["doc_id"]: (r["labels"], r["score"], r["detections"]) for r in licenses.scan_licenses(df).collect()}
    filtered = scan()
    assert all(filtered[i][2] for i, _ in enumerate(texts))
    monkeypatch.setattr(licenses, "KEYWORDS", [[" "]] * len(licenses.RULES))
    monkeypatch.setattr(licenses, "ANCHORS", " ")
    monkeypatch.setattr(licenses, "_anchors", lambda keywords: [" "])
    assert filtered == scan()


@pytest.fixture(scope="module")
def piece_model():
    from quadrille.llm import sentencepiece_ops as ops

    return ops.Model(tokenizer_file("piece_bpe_32k.model"))


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


NASTY_TEXTS = ["  two  spaces, stops... end. ", "a.b,c! x2. ². _. Ünï€ 日本語", "line\n\nline\ttab \x00\x7f\r\n.", "x" * 200 + "y." * 50, "▁literal▁ mark", "..", " ", "\n"]


def test_units_join_to_their_text():
    from quadrille.llm import sentencepiece_ops as ops

    for t in NASTY_TEXTS:
        assert "".join(ops.units(t)).replace(ops.SPACE, " ") == " " + t.replace(ops.SPACE, " ")
    assert ops.units("Go on, x2. end") == ["▁Go", "▁on", ",", "▁x2.", "▁end"] and ops.units(None) == ops.units("") == []


def test_sentencepiece_takes_the_best_path(spark, docs, piece_model):
    """The lattice's ids are those of the best path through a whole text, found one by one; they decode to the text."""
    from quadrille.llm import sentencepiece_ops as ops

    table = {p: (i, s) for i, p, s in piece_model.pieces}
    texts = dict(enumerate([t for _, t, *_ in rows()] + NASTY_TEXTS))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in ops.decode(ops.encode_documents(df, piece_model), piece_model).collect()}
    for i, t in texts.items():
        whole = (" " + t).replace(" ", ops.SPACE) if t else ""
        score = lambda ids, whole=whole: sum(piece_model.worst if 0 <= x - piece_model.byte0 < 256 else table[library().id_to_piece(x)][1] for x in ids)
        assert got[i][1] == (t or "").replace(ops.SPACE, " ")
        if len(whole) < 4000 and whole.isascii() is False and not any(0 <= x - piece_model.byte0 < 256 for x in got[i][0]):
            assert score(got[i][0]) == pytest.approx(score(ops.best_path(whole, piece_model, table)))


def best_score(whole, pieces, worst):
    """The best sum of scores of any cut of a whole text into pieces and characters without one, by a table over all ends."""
    longest, best = max(map(len, pieces)), [0.0]
    for e in range(1, len(whole) + 1):
        best.append(max(best[s] + (pieces[whole[s:e]] if whole[s:e] in pieces else worst if e - s == 1 else -math.inf) for s in range(max(0, e - longest), e)))
    return best[-1]


@pytest.mark.parametrize("chunk", [40, 1 << 21])
def test_sentencepiece_reaches_the_best_score_of_the_whole_text(spark, piece_model, chunk):
    """Nothing of the module makes the expected score: the cut into units loses no better path, in one chunk a task or many."""
    from quadrille.llm import sentencepiece_ops as ops

    pieces = {p: s for _, p, s in piece_model.pieces}
    name = {i: p for i, p, _ in piece_model.pieces}
    texts = dict(enumerate([t for _, t, *_ in rows() if len(t or "") < 4000] + NASTY_TEXTS))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["ids"] for r in ops.encode_documents(df, piece_model, chunk=chunk, batch=50).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        whole = (" " + t).replace(" ", ops.SPACE) if t else ""
        runs, score, said = [], 0.0, ""
        for x in [*got[i], None]:
            if x is not None and 0 <= x - piece_model.byte0 < 256:
                runs.append(x - piece_model.byte0)
                continue
            lone = bytes(runs).decode("utf-8")
            runs, score, said = [], score + len(lone) * piece_model.worst, said + lone
            if x is not None:
                score, said = score + pieces[name[x]], said + name[x]
        assert said == whole and score == pytest.approx(best_score(whole, pieces, piece_model.worst))


def test_sentencepiece_merges_are_the_library(spark, docs, piece_model):
    from quadrille.llm import sentencepiece_ops as ops

    texts = dict(enumerate([t for _, t, *_ in rows()] + NASTY_TEXTS))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sp = library()
    assert {r["doc_id"]: r["ids"] for r in ops.encode_documents(df, piece_model, method="merges", chunk=300, batch=300).collect()} == {i: sp.encode(t or "") for i, t in texts.items()}


def test_sentencepiece_refuses_rows_in_another_order(spark, tmp_path, piece_model):
    """Chunks that have as many distinct units but others at the second reading are an error, not wrong ids."""
    from quadrille.llm import sentencepiece_ops as ops

    texts = [" ".join(f"{c}{i}" for i in range(50)) for c in "ab"]

    def turning(batches):
        for b in batches:
            n = len(list(tmp_path.iterdir()))
            (tmp_path / str(n)).touch()
            yield b.iloc[:: -1 if n % 2 else 1]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).mapInPandas(turning, "doc_id long, text string")
    with pytest.raises(Exception, match="cut in two ways"):
        for _ in range(2):  # one of two runs in a row begins its readings in the turned order
            ops.document_codes(df, piece_model).collect()
            ops.encode_documents(df, piece_model, chunk=40, batch=50).collect()
            (tmp_path / "turn").touch()


def test_sentencepiece_query_encodes_and_decodes(spark, tmp_path, piece_model):
    """The registered query tells the whole id sequence and the decoded text of each document, of repeated rows too."""
    from quadrille.llm import sentencepiece_ops as ops
    from quadrille.llm.queries import op4_sentencepiece

    pieces = {p: (i, s) for i, p, s in piece_model.pieces}
    table = [*rows(), rows()[0], rows()[11], (None, "no id", "en", "s", 5)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = lambda t: [i for u in ops.units(t) for i in ops.best_path(u, piece_model, pieces)]
    expected = sorted((str(i), len(ids(t)), sha(",".join(map(str, ids(t)))), sha(t or ""), True) for i, t, *_ in table)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["exact"]) for r in op4_sentencepiece(spark, str(tmp_path)).collect()) == expected


def test_rows_of_one_id_are_cut_each_by_its_own_spans(spark):
    passage, tails = prose(40, 60), [prose(41 + i, 30) for i in range(4)]
    table = [(0, f"{passage} {tails[0]}"), (1, "short text"), (1, f"{passage} {tails[1]}"), (1, f"{passage} {tails[1]}"), (None, f"{passage} {tails[2]}"), (None, None), (2, None), (2, f"{tails[3]} {passage}")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in table], SCHEMA)
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in suffix_dedup.drop_repeats(df).collect()), key=str)
    want = [(0, table[0][1]), (1, "short text"), (1, tails[1]), (1, tails[1]), (None, table[4][1]), (None, None), (2, None), (2, tails[3])]
    assert got == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=str)
    spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(df).collect()}
    # The rows that agree in id and text repeat each other as a whole.
    assert spans == {(0, 0, 60), (1, 0, 90), (2, 30, 90)}


def test_empty_tables(empty):
    from quadrille.llm import sentencepiece_ops as ops

    path = tokenizer_file("word_bpe_49k.json")
    for df in (
        exact_dedup.exact_groups(empty), exact_dedup.exact_dedup(empty), ngram_join.similar_components(empty), suffix_dedup.repeated_passages(empty), suffix_dedup.drop_repeats(empty), line_dedup.clean_lines(empty),
        quality.judge(empty), quality.quality_filter(empty), packing.packed_documents(empty, path), hmm.score_documents(empty), licenses.scan_licenses(empty), ops.document_codes(empty, ops.Model(tokenizer_file("piece_bpe_32k.model"))),
    ):
        assert df.count() == 0


def test_extra_columns_survive(docs):
    more = docs.select("*", F.lit(1).alias("n_words"), F.lit("x").alias("p"), F.lit(0.5).alias("scale"), F.lit(7).alias("c00"), F.lit(8).alias("m0"), F.lit("n").alias("node"), F.lit(2).alias("s"), F.lit(3).alias("block"), F.lit(4).alias("length"))
    for stage in (exact_dedup.exact_dedup, ngram_join.drop_near_duplicates, suffix_dedup.drop_repeats, quality.quality_filter):
        out = stage(more)
        assert out.columns == more.columns and out.where("n_words <> 1 OR p <> 'x' OR s <> 2").count() == 0
