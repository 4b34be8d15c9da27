import random
from collections import Counter

import numpy as np

from millrace.llm import scans, subjects

NAMES = ["science", "sport"]
WORDS = {
    "science": "membrane catalyst photon orbit genome solvent crystal isotope plasma telescope spectrometer particle".split(),
    "sport": "referee stadium goalkeeper penalty sprint league podium racket relay striker playoff defender".split(),
}


def sentence(rng, subject):
    a, b, c = rng.sample(WORDS[subject], 3)
    return f"The {a} of the {rng.choice(['north', 'south', 'east'])} office must be ready before the {b} and the {c} arrive in {rng.choice(['May', 'June'])}."


def test_subjects(spark):
    rng = random.Random(1)
    docs, truth, labels = [], {}, []
    for i in range(300):
        own = [rng.choice(NAMES)] if i % 5 else NAMES[:]
        parts = [" ".join(sentence(rng, s) for _ in range(4)) for s in own]
        if i % 7 == 0 and len(own) == 1:  # in passing
            other = NAMES[1 - NAMES.index(own[0])]
            parts[0] += " " + sentence(rng, other) + " " + " ".join(sentence(rng, own[0]) for _ in range(3))
        docs.append((i, "\n\n".join(parts), "x"))
        truth[i] = set(own)
        if i < 40 and len(own) == 1:
            labels.append((i, own[0].upper() if i % 3 else own[0], "x"))
    labels += labels[:3] + [(1, None, "x"), (2, "cooking", "x"), (None, "sport", "x"), (3, NAMES[0], "x")]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "12 34\n56", "x"), (1003, "   ", "x")]
    d = spark.createDataFrame(docs, "doc_id int, text string, subject string")
    s = spark.createDataFrame([(n, "d") for n in NAMES], "subject string, description string")
    lab = spark.createDataFrame(labels, "doc_id int, subject string, labelled_by string")
    found = {}
    for r in subjects.subjects_of(d, s, lab).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert not {1000, 1001, 1002, 1003} & set(found)
    assert sum(found.get(i, set()) == t for i, t in truth.items()) / len(truth) >= 0.95
    assert subjects.subjects_of(d.where("false"), s, lab).count() == 0
    assert subjects.subjects_of(d, s.where("false"), lab).count() == 0


SENTENCES = [
    "The committee must be ready before the generator can transmit again.",
    "Every transformer carries the mark AB-12345, and the office will examine it in July.",
    "About 585 kilograms after the notice, the pipeline began to affect the region.",
    "A hand-written register was kept for the supplier and the national network.",
    "Nobody could explain why the winter estimate moved from 832 to 125 batches.",
]


def page_text():
    last = {7: "and the tlie national network.", 8: "Nobody could exp1ain why", 9: "About 5B5 kilograms moved from the winter."}
    pages = []
    for n in (7, 8, 9):
        body = ["The committee must be ready before the gen-", "erator can transmit again. A hand-", "written register was kept for the supp1ier", last[n]]
        pages.append("\n".join(["Yearly Report Tinvel" if n < 9 else "Yearly Rep0rt Tinvel", *body, f"— {n} —"]))
    return "\n".join(pages)


def test_noisy_lines_and_repair(spark):
    clean = [(i, " ".join(SENTENCES) + f" {i}", "k") for i in range(5)]
    odd = [(90, None, "k"), (91, "", "k"), (92, "doc_id: 5", "k"), (93, "series\n" + "\n".join(str(i * 37 % 1000) for i in range(40)), "k"), (94, "x " * 50_000, "k")]
    docs = spark.createDataFrame([*clean, (50, page_text(), "k"), (50, page_text(), "k"), *odd], "doc_id int, text string, kind string")
    got = {(r.line_no, r.kind) for r in scans.noisy_lines(docs).where("doc_id = 50").collect()}
    want = set()
    for p in range(3):
        at = 6 * p
        want |= {(at + 1, "furniture"), (at + 6, "furniture"), (at + 2, "hyphen"), (at + 4, "misread"), (at + 5, "misread")}
    assert got == want
    assert scans.noisy_lines(docs).where("doc_id <> 50").count() == 0
    texts = {r.doc_id: r.text for r in scans.repaired_texts(docs).collect()}
    assert all(texts[i] == t for i, t, _ in [*clean, *odd])
    assert "generator can transmit again. A hand-written register was kept for the supplier and the" in texts[50]
    assert "Yearly" not in texts[50] and "—" not in texts[50]
    assert scans.noisy_lines(docs.where("false")).count() == 0


def test_chain_and_roman():
    assert scans._chain([(0, 5), (3, 9), (10, 6), (11, 100), (20, 7)], 4) == [0, 10, 20]
    assert [scans._roman(x) for x in ("i", "iv", "ix", "xii")] == [1, 4, 9, 12]


def test_edits():
    lexicon = {"winter": 3, "have": 2}
    assert ("winter", 2) in scans.edits("wirter", {"winter": 1}, 1) or scans.edits("wiriter", lexicon)
    assert scans.edits("liave", lexicon)[0][0] == "have"
    assert scans.edits("zzzz", lexicon) == []


def test_a_misread_that_is_another_word(spark):
    rng = random.Random(4)
    animals = [f"The {rng.choice(['grey', 'small', 'young'])} bat flew {rng.choice(['silently', 'quickly'])} out of its cave at dusk {i}." for i in range(150)]
    clothes = [f"Her {rng.choice(['woollen', 'straw', 'felt'])} hat sat upon {rng.choice(['his', 'her'])} head and scarf {i}." for i in range(150)]
    page = ["Yearly Report Tinvel", "Her straw bat sat upon his head and scarf.", "The small bat flew silently out of its cave.", "Her felt hat sat upon her head and scarf.", "", "— {} —"]
    text = "\n".join("\n".join(page).format(n) for n in (7, 8, 9))
    docs = spark.createDataFrame([*enumerate(animals + clothes), (900, text)], "doc_id int, text string")
    got = {(r.line_no, r.kind) for r in scans.noisy_lines(docs).where("kind = 'misread'").collect()}
    assert got == {(2, "misread"), (8, "misread"), (14, "misread")}
    repaired = scans.repaired_texts(docs).where("doc_id = 900").first().text
    assert repaired.count("straw hat sat") == 3 and repaired.count("small bat flew") == 3


def test_every_lexicon_word_has_a_vector(spark):
    words = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(3000)]
    docs = spark.createDataFrame([(" ".join(words[i : i + 100]),) for i in range(0, 3000, 100)], "text string")
    vectors = scans._vectors(docs, "text", dict.fromkeys(words, 2))
    assert set(vectors.number) == set(words)
    assert (abs(vectors.outer).max(1) > 0).mean() > 0.99  # each pair is seen only once


def test_lexicon_keeps_rare_words(spark):
    """Two documents are enough, however many there are; other words than those sought on scanned pages stay away."""
    text = page_text()
    rows = [(None, text, scans.scanned(text), None, None), *((None, None, None, w, n) for w, n in [("register", 2), ("supplier", 60_000), ("cornmittee", 1), ("zebra", 9), ("hand-written", 3), ("hand-made", 3)])]
    rows += [(None, None, None, "the", 60_000)] * 2
    read = spark.createDataFrame(rows, "id int, text string, furniture array<int>, word string, n long")
    pages = read.where("text IS NOT NULL").select("text", "furniture")
    assert dict(map(tuple, scans._lexicon(read, pages).collect())) == {"register": 2, "supplier": 60_000, "hand-written": 3, "the": 120_000}


def test_a_large_lexicon_is_held_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([*((i, " ".join(SENTENCES) + f" {i}") for i in range(5)), *((50 + i, page_text()) for i in range(6))], "doc_id int, text string")
    whole = sorted(map(tuple, scans.noisy_lines(docs).collect()))
    monkeypatch.setattr(scans, "LEXICON_WORDS", 40)
    monkeypatch.setattr(scans, "MOST_BITS", 2)
    assert whole and sorted(map(tuple, scans.noisy_lines(docs).collect())) == whole
    assert scans.repaired_texts(docs).count() == 11


def test_singular_vectors_settle(spark):
    """The subspace holds as much of the matrix as the leading singular vectors do."""
    import numpy as np

    rng = random.Random(8)
    words = [f"{a}{b}{c}x" for a in "bcdfg" for b in "aeiou" for c in "klmnprst"]
    docs = spark.createDataFrame([(i, "The " + " ".join(rng.choices(words, k=40)) + ".") for i in range(400)], "doc_id int, text string")
    packed = subjects._sentences(docs, "doc_id", "text")
    weight = np.ones(subjects.TERMS, np.float32)
    df = subjects._statistics(packed)[0]
    vectors, place = subjects._singular_vectors(packed, weight, df)
    q = np.where(df[: subjects.LANGUAGE_TERMS, None] > 0, vectors[place[: subjects.LANGUAGE_TERMS]], 0)
    a = np.zeros((400, subjects.LANGUAGE_TERMS))
    for r in packed.collect():
        b = subjects._unpack(r.ids, bytes(r.terms), bytes(r.rest))
        np.add.at(a, (np.array(r.ids)[np.repeat(b.document, b.lengths)], b.terms), 1)
    a = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    best = (np.linalg.svd(a, compute_uv=False)[: subjects.RANK] ** 2).sum()
    assert ((a @ q) ** 2).sum() >= 0.98 * best


def test_more_subjects_than_fit_a_page(spark):
    names = [f"{n} {i}" for i in range(5001) for n in NAMES] + NAMES
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(sentence(rng, NAMES[i % 2]) for _ in range(4))) for i in range(60)], "doc_id int, text string")
    s = spark.createDataFrame([(n,) for n in names], "subject string")
    lab = spark.createDataFrame([(i, NAMES[i % 2]) for i in range(20)], "doc_id int, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(docs, s, lab).collect()}
    assert len(got & {(i, NAMES[i % 2]) for i in range(60)}) >= 57


def test_unknown_accented_words_are_no_misreads():
    import numpy as np

    none = scans.Vectors([], np.zeros((0, 32), np.float32), np.zeros((0, 32), np.float32))
    reader = scans.Reader({"winter": 5, "coffee": 4}, none)
    assert reader.readings("Café") is None and reader.readings("wintér") == [("winter", 4)]
    assert scans._in_parts("Plant | Manual | 2020") and not scans._in_parts("| a | b |")


def test_a_common_misread_is_not_known_however_often_it_is_met(spark):
    assert scans.trusted({"supplier": 600_000, "supp1ier": 90, "modern": 900, "modem": 40}) == {"supplier": 600_000, "modern": 900, "modem": 40}
    clean = [(i, " ".join(SENTENCES) + f" {i}") for i in range(600)]
    missed = [(1000 + i, "Nobody could exp1ain why the supp1ier moved.") for i in range(2)]  # scanned, but nothing shows it
    docs = spark.createDataFrame([*clean, *missed, (50, page_text())], "doc_id int, text string")
    got = {r.line_no for r in scans.noisy_lines(docs).where("doc_id = 50 AND kind = 'misread'").collect()}
    assert got == {4, 5, 10, 11, 16, 17}


def test_encoded_data_has_no_words():
    data = "blJw3SQQeEPqBsfAsD23Jr+3C6Al/CWZYvRQeXgINbJhWGddZNBo8riS9Y7K9A0FdDEeMPyUNJ/fo/CgaWBntvIMX+2KvYnlN"
    assert scans.words_of(f"the data:image/png;base64,{data} winter") == {"the", "data", "image", "png", "base64", "winter"}
    path = "/".join(["winter", "report", "supplier", "register", "notice", "transformer", "kilograms"])
    assert scans.words_of(path) == set(path.split("/"))


def test_one_broken_word_tells_a_scanned_text_if_the_lexicon_knows_it(spark):
    clean = [(i, " ".join(SENTENCES) + f" {i}") for i in range(5)]
    broken = "Every transformer carries the mark and the gen-\nerator can transmit again.\nA register was kept for the supp1ier\nand the national network."
    compound = "Every transformer carries the mark and a hand-\nwritten register was kept.\nThe generator can transmit for the 5upplier\nand the national network."
    docs = spark.createDataFrame([*clean, (50, broken), (51, compound)], "doc_id int, text string")
    assert {tuple(r) for r in scans.noisy_lines(docs).collect()} == {(50, 1, "hyphen"), (50, 3, "misread")}
    texts = {r.doc_id: r.text for r in scans.repaired_texts(docs).collect()}
    assert texts[51] == compound and "the generator can transmit again. A register was kept for the supplier and" in texts[50]


def test_words_are_counted_together_as_text_by_text():
    texts = ["A hand-written note, a-b-cd 12 and 12 x1", "", "Über-all (é!a) b|c d!5 q(r \U0001f600 𐐨b_c", "-ab ab-cd", f"{'aB3' * 30} long-word", "Donaudampfschifffahrtsgesellschaft 7", "a\nnote\rx\x00y"]
    counts, one_by_one = Counter(), Counter()
    scans._count_words(counts, texts)
    for t in texts:
        low = t.lower()
        assert scans.tokens(low) == scans._WORD.findall(low)
        one_by_one.update(w for w in scans.words_of(t) if not w.isdigit())
    assert counts == one_by_one and counts["hand-written"] == counts["ab-cd"] == 1 and counts["note"] == 2


def test_numbers_are_not_counted(spark):
    docs = spark.createDataFrame([(i, f"note {i} of 2024 by x{i}") for i in range(20)], "id int, text string")
    words = {r.word for r in scans._read(docs, "id", "text").where("word IS NOT NULL").collect()}
    assert words == {"note", "of", "by"} | {f"x{i}" for i in range(20)}


def test_layout_of_a_text_is_looked_at_once(monkeypatch):
    seen, real = [], scans._laid_out
    monkeypatch.setattr(scans, "_laid_out", lambda lines: seen.append(1) or real(lines))
    assert scans.scanned("one line\nand another\nof plain text\nwithout pages") is None
    assert len(seen) == 1


def test_sums_are_those_of_reduceat():
    rng = np.random.default_rng(1)
    for most in (1, 2, 5, 40):
        size = rng.integers(1, most + 1, 200)
        values = rng.standard_normal((int(size.sum()), 8)).astype(np.float32)
        first = np.cumsum(size) - size
        assert np.array_equal(scans._sums(values, first), np.add.reduceat(values, first, axis=0))
