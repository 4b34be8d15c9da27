"""Subjects of documents: latent semantic vectors and refined seed centroids.

Sentences become vectors by weighting terms by their rarity over all documents
and projecting them on the leading singular vectors of the term-document
matrix.  Hand-labelled documents give a first centroid for each subject and
language; rounds over the whole corpus replace it by the mean of the sentences nearest to it.
A document is about a subject if a run of its sentences is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut_lineage, spread, unzipped, zipped

#: Languages have term numbers, rarities and singular vectors of their own; texts without any telling word are "other".
LANGUAGES = ["en", "de", "es", "zh", "other"]
#: Terms of a language are hashed to so many numbers.
LANGUAGE_TERMS = 1 << 15
TERMS = LANGUAGE_TERMS * len(LANGUAGES)
#: Singular vectors kept for each language.
RANK = 32
#: Passes go on until less than this share of a language's weight on its singular vectors moves; most passes.
SETTLED = 1e-3
MOST_PASSES = 30
#: The centroids move until none turns by more than this (1 - cosine); most rounds.
STILL = 1e-4
MOST_ROUNDS = 50
#: Labelled documents used as seeds at most (those with the smallest ids).
MAX_LABELS = 50_000
#: Least cosine of a sentence to its subject, and least lead over the next subject.
LEAST_COSINE = 0.20
LEAST_LEAD = 0.06
#: Sentences in a row that make a subject of a document; a shorter paragraph counts if all of it is on the subject.
RUN = 3
#: Terms of a sentence; stretches without an end that are twice as long are cut to this length.
LONG_SENTENCE = 16
#: Documents packed together, and rows of the matrix that are multiplied together.
BLOCK_ROWS = 256
DENSE_ROWS = 32
#: Rows of a product that are added up together; tables of more partitions are added up in two steps.
CHUNK_ROWS = 4096
ONE_STEP = 64

# Frequent function words that tell the languages apart.
_FUNCTION_WORDS = {
    "en": "the of and to in is for that with was on by it from or be as at this are an not has will must before",
    "de": "der die und das den von zu mit ist für auf dem im nicht ein eine des sich bei wird nach vor wurde sind",
    "es": "el los las del que en por con una para se es al como su sin sobre más según hasta entre fue",
}
_LANGUAGE_OF = {w: i for i, k in enumerate(("en", "de", "es")) for w in _FUNCTION_WORDS[k].split()}

_BREAK = re.compile(r"(?<=[.!?])[ \t\r\n]+|(?<=[。！？])[ \t\r\n]*|\n[ \t\r]*\n\s*|\n(?=[ \t]*(?:[-*#•]|[QA]:|\d+[.)]))")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_JOINED = re.compile(r"(?<=\w)[-­¬‐]\r?\n[ \t]*(?=[a-zäöüßáéíóúñ])")
_TOKEN = re.compile(r"(?<![^\W_])[^\W\d_一-鿿]+(?![^\W_一-鿿])")
_ASCII_TOKEN = re.compile(r"(?<![a-z0-9])[a-z]+(?![a-z0-9])")
_CJK = re.compile(r"[一-鿿]+")


class _Numbers(dict):
    """Number of each word: its hashed term, -1 for words that don't count, -2 - language for function words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        if word in _LANGUAGE_OF:
            n = -2 - _LANGUAGE_OF[word]
        elif len(word) < 3 or len(word) >= 30:
            n = -1
        else:
            n = xxhash.xxh64_intdigest(word) % LANGUAGE_TERMS
        self[word] = n
        return n


class Block(NamedTuple):
    """Sentences of some documents, one after the other."""

    ids: list
    document: np.ndarray  # of each sentence, a position in ids
    terms: np.ndarray  # of all sentences
    lengths: np.ndarray  # of each sentence
    paragraph: np.ndarray
    language: np.ndarray


_ZH, _OTHER = LANGUAGES.index("zh"), LANGUAGES.index("other")


def read_block(ids: list, texts: list[str], number) -> Block:
    """Sentences, hashed terms and languages of texts; ``number`` maps a word to its number."""
    words: list[str] = []
    counts, documents, paragraphs, cjk = [], [], [], []
    for d, text in enumerate(texts):
        text = text.lower()
        if "\n" in text:
            text = _JOINED.sub("", text)
        ascii_only = text.isascii()
        for p, paragraph in enumerate(_PARAGRAPH.split(text)):
            for sentence in _BREAK.split(paragraph):
                chars = 0
                if ascii_only:
                    own = _ASCII_TOKEN.findall(sentence)
                else:
                    own = _TOKEN.findall(sentence)
                    for run in _CJK.findall(sentence):
                        chars += len(run)
                        own += [run[i : i + 2] + "  " for i in range(len(run) - 1)]  # as long as a word that counts
                if own:
                    words += own
                    counts.append(len(own)), documents.append(d), paragraphs.append(p), cjk.append(chars)
    count, document, paragraph = np.array(counts, np.int64), np.array(documents, np.int64), np.array(paragraphs, np.int64)
    code = np.fromiter(map(number, words), np.int64, len(words))
    sentence = np.repeat(np.arange(len(count)), count)
    votes = np.zeros((len(count), len(LANGUAGES)), np.int64)
    function = code <= -2
    np.add.at(votes, (sentence[function], -2 - code[function]), 1)
    votes[:, _ZH] = cjk
    language = np.where(votes.max(1) > 0, votes.argmax(1), -1) if len(count) else np.empty(0, np.int64)
    keep = code >= 0
    code, sentence = code[keep], sentence[keep]
    length = np.bincount(sentence, minlength=len(count))
    # text without punctuation goes in stretches of about a sentence's length
    parts = np.where(length > 2 * LONG_SENTENCE, np.round(length / LONG_SENTENCE), (length > 0) * 1).astype(np.int64)
    which = np.repeat(np.arange(len(count)), parts)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    lengths = length[which] * (turn + 1) // np.maximum(parts[which], 1) - length[which] * turn // np.maximum(parts[which], 1)
    return _with_languages(ids, document[which], code, lengths, paragraph[which], language[which])


def _with_languages(ids, document, terms, lengths, paragraph, language) -> Block:
    """Sentences without a telling word get the language of their text, and terms the range of their language."""
    n = np.zeros((len(ids), len(LANGUAGES)), np.int64)
    known = language >= 0
    np.add.at(n, (document[known], language[known]), 1)
    text_language = np.where(n.any(1), n.argmax(1), _OTHER)
    language = np.where(known, language, text_language[document]) if len(language) else language
    return Block(ids, document, terms + np.repeat(language, lengths) * LANGUAGE_TERMS, lengths, paragraph, language)


def _pack(b: Block) -> tuple[bytes, bytes]:
    """The sentences' terms, and the rest of a block."""
    local = (b.terms % LANGUAGE_TERMS).astype(np.uint16)
    return zipped(local), zipped(b.document.astype(np.int32), b.lengths.astype(np.int32), b.paragraph.astype(np.int32), b.language.astype(np.int32))


def _unpack(ids: list, terms: bytes, rest: bytes) -> Block:
    document, lengths, paragraph, language = (x.astype(np.int64) for x in unzipped(rest, [np.int32] * 4))
    (local,) = unzipped(terms, [np.uint16])
    return Block(ids, document, local + np.repeat(language, lengths) * LANGUAGE_TERMS, lengths, paragraph, language)


def _matrix_rows(b: Block) -> bytes:
    """Rows of the document-term matrix (one for each language of a document): row, term and count of each entry."""
    pair, n = np.unique(np.repeat(b.document, b.lengths) * TERMS + b.terms, return_counts=True)
    edge = np.r_[True, np.diff(pair // LANGUAGE_TERMS) != 0] if len(pair) else np.empty(0, bool)
    return zipped((np.cumsum(edge) - 1).astype(np.int32), (pair % TERMS).astype(np.int32), n.astype(np.int32))


def _sentences(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``ids, terms, rest, rows``: blocks of documents, and their rows of the document-term matrix."""
    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL"))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers().__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(at, BLOCK_ROWS)
                block = read_block(b.column(0).to_pylist(), b.column(1).to_pylist(), number)
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in (*_pack(block), _matrix_rows(block)))], names=["ids", "terms", "rest", "rows"])

    return cut_lineage(rows.mapInArrow(run, f"ids array<{kind}>, terms binary, rest binary, rows binary"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for ids, terms, rest in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            yield _unpack(ids, terms, rest)


def _statistics(sentences: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents with each term; documents and sentences of each language; the terms' weights in all sentences together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, TERMS + len(LANGUAGES)))
        for batch in batches:
            for terms, rest, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b = _unpack([], terms, rest)
                n[0, :TERMS] += np.bincount(unzipped(rows, [np.int32] * 3)[1], minlength=TERMS)
                n[0, TERMS:] += np.bincount(np.unique(b.document * len(LANGUAGES) + b.language) % len(LANGUAGES), minlength=len(LANGUAGES))
                n[1, :TERMS] += np.bincount(b.terms, np.repeat(b.lengths**-0.5, b.lengths), TERMS)
                n[1, TERMS:] += np.bincount(b.language, minlength=len(LANGUAGES))
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], names=["term", "n", "w"])

    rows = sentences.select("terms", "rest", "rows").mapInArrow(run, "term long, n double, w double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow()
    n = np.zeros((2, TERMS + len(LANGUAGES)))
    n[:, rows.column("term").to_numpy()] = rows.column("n").to_numpy(), rows.column("w").to_numpy()
    return n[0, :TERMS], n[0, TERMS:], n[1, TERMS:], n[1, :TERMS]


def _multiply(blocks: Iterator[bytes], weight: np.ndarray, place: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A q over some blocks, A the matrix of rows of length 1; ``place`` has each term's row of q and ``weight`` its rarity."""
    out = np.zeros(q.shape, np.float32)
    for data in blocks:
        row, term, n = unzipped(data, [np.int32] * 3)
        if not len(row):
            continue
        value = (1 + np.log(n)) * weight[term]
        value = (value / np.maximum(np.sqrt(np.bincount(row, value * value)), 1e-9)[row]).astype(np.float32)
        at, last = place[term], int(row[-1])
        edges = np.searchsorted(row, np.arange(0, last + 1 + DENSE_ROWS, DENSE_ROWS))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, local = np.unique(at[i:j], return_inverse=True)
            dense = np.zeros((DENSE_ROWS, len(own)), np.float32)
            dense[row[i:j] % DENSE_ROWS, local] = value[i:j]
            out[own] += dense.T @ (dense @ q[own])
    return out


def _product(rows: DataFrame, weight: np.ndarray, place: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A q over all documents.

    A task adds up its part of the product, one for each core at most; parts are
    added up by chunk of rows, so that no more than one such matrix reaches the
    driver.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((weight, place, q))
    cores = spark.sparkContext.defaultParallelism
    salts = 1 if cores <= ONE_STEP else int(np.ceil(np.sqrt(cores)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weight, place, q = shared.value
        out = _multiply((data for batch in batches for data in batch.column(0).to_pylist()), weight, place, q)
        salt = TaskContext.get().partitionId() % salts
        for c, low in enumerate(range(0, len(q), CHUNK_ROWS)):
            part = out[low : low + CHUNK_ROWS]
            at = np.flatnonzero(part.any(1)).astype(np.int32)  # a task meets few of the rare terms
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([salt], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["chunk", "salt", "at", "part"])

    def total(table: pa.Table) -> pa.Table:
        added = np.zeros((CHUNK_ROWS, columns), np.float32)
        for at, part in zip(table.column("at").to_pylist(), table.column("part").to_pylist(), strict=True):
            added[np.frombuffer(at, np.int32)] += np.frombuffer(part, np.float32).reshape(-1, columns)
        at = np.flatnonzero(added.any(1)).astype(np.int32)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "salt": table.column("salt").slice(0, 1), "at": pa.array([at.tobytes()], pa.binary()), "part": pa.array([added[at].tobytes()], pa.binary())})

    schema, columns = "chunk int, salt int, at binary, part binary", q.shape[1]
    added = rows.coalesce(cores).mapInArrow(run, schema)
    for keys in [["chunk"]] if salts == 1 else [["chunk", "salt"], ["chunk"]]:
        added = added.groupBy(*keys).applyInArrow(total, schema)
    out = np.zeros_like(q)
    for r in added.collect():
        out[r.chunk * CHUNK_ROWS + np.frombuffer(r.at, np.int32)] = np.frombuffer(r.part, np.float32).reshape(-1, columns)
    shared.destroy()
    return out


def _singular_vectors(sentences: DataFrame, weight: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of each language's document-term matrix, and each term's row in them.

    Block Krylov iteration over all documents: every pass multiplies by the
    matrix once and adds RANK columns to a language's basis; the best vectors
    in it are taken, until they settle.  A language that has settled takes no
    part in further passes.
    """
    terms = np.flatnonzero(df > 0)
    place = np.zeros(TERMS, np.int64)
    place[terms] = np.arange(len(terms))
    cut = np.searchsorted(terms, LANGUAGE_TERMS * np.arange(len(LANGUAGES) + 1))
    spans = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    rows = sentences.select("rows")
    start = np.random.default_rng(5).standard_normal((len(terms), RANK)).astype(np.float32)
    return _krylov(lambda q: _product(rows, weight, place, q), start, spans), place


def _krylov(multiply, start: np.ndarray, spans: list[slice]) -> np.ndarray:
    """Leading eigenvectors of each language's span of rows, from products ``multiply``."""

    def orthonormal(y: np.ndarray, bases: list[list[np.ndarray]]) -> np.ndarray:
        """Columns of y made orthonormal to each language's basis and to each other."""
        out = np.zeros(y.shape, np.float32)
        for span, basis in zip(spans, bases, strict=True):
            own = y[span].astype(np.float64)
            if not own.any():
                continue
            for _ in range(2):  # twice, for rounding
                for b in basis:
                    own -= b @ (b.T @ own)
            columns, size, _ = np.linalg.svd(own, full_matrices=False)
            keep = size > 1e-9 * max(size[0], 1e-30)  # a small language runs out of directions
            out[span, : int(keep.sum())] = columns[:, keep]
        return out

    bases: list[list[np.ndarray]] = [[] for _ in spans]
    images: list[list[np.ndarray]] = [[] for _ in spans]
    q = orthonormal(start, bases)
    best = np.zeros_like(q)
    for _ in range(MOST_PASSES):
        y = multiply(q)
        for k, span in enumerate(spans):
            if not q[span].any():
                continue
            bases[k].append(q[span]), images[k].append(y[span])
            inner = np.block([[b.T @ i for i in images[k]] for b in bases[k]]).astype(np.float64)
            value, turn = np.linalg.eigh((inner + inner.T) / 2)
            value, turn = np.maximum(value[::-1][:RANK], 0), turn[:, ::-1][:, :RANK].astype(np.float32)
            before, best[span] = best[span].copy(), sum(b @ t for b, t in zip(bases[k], np.split(turn, len(bases[k])), strict=True))
            outside = 1 - ((before.T @ best[span]) ** 2).sum(0)
            if (value * outside).sum() <= SETTLED * value.sum():
                y[span] = 0
        if not y.any():
            break
        q = orthonormal(y, bases)
    return best


class Model:
    """Projection of terms and the languages' means."""

    def __init__(self, project: np.ndarray, place: np.ndarray, mean: np.ndarray):
        self.project, self.place, self.mean = project, place, mean

    def embed(self, b: Block) -> np.ndarray:
        """Sentences' vectors less their language's mean, at length 1 (or 0)."""
        if not len(b.lengths):
            return np.zeros((0, RANK), np.float32)
        x = np.add.reduceat(self.project[self.place[b.terms]], np.cumsum(b.lengths) - b.lengths, axis=0)
        x = x / (b.lengths[:, None] ** 0.5).astype(np.float32) - self.mean[b.language]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)


class Centroids:
    """Centroids (language x subject x RANK), and which of them there are."""

    def __init__(self, centroid: np.ndarray, usable: np.ndarray):
        self.centroid, self.usable = centroid, usable

    def score(self, x: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Cosine of each sentence to each subject; -1 where the language has no centroid."""
        out = np.full((len(x), self.centroid.shape[1]), -1, np.float32)
        for k in np.unique(language):
            own = language == k
            out[own] = np.where(self.usable[k], x[own] @ self.centroid[k].T, -1)
        return out


def _embedded(sentences: DataFrame, model: Model, kind: str) -> DataFrame:
    """``ids, rest, x``: the blocks with their sentences' vectors in half precision instead of terms."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.embed(_unpack([], t, r)).astype(np.float16).tobytes() for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["ids", "rest", "x"])

    return cut_lineage(sentences.select("ids", "terms", "rest").mapInArrow(run, f"ids array<{kind}>, rest binary, x binary"))


def _vectors_of(rest: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, paragraph, language and vector of a block's sentences."""
    document, _, paragraph, language = unzipped(rest, [np.int32] * 4)
    return document, paragraph, language, np.frombuffer(x, np.float16).reshape(-1, RANK).astype(np.float32)


def _gather(blocks: DataFrame, shared, work) -> np.ndarray:
    """Sum over all blocks of the arrays (of rows of RANK + 1) that ``work`` makes, by task and then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0
        for b in batches:
            for columns in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                out = out + work(shared.value, *columns)
        if not np.isscalar(out):
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at])], names=["i", "v"])

    parts = blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    at = parts.column("i").to_numpy()
    out = np.zeros((int(at.max(initial=0)) // (RANK + 1) + 1) * (RANK + 1))
    out[at] = parts.column("v").to_numpy()
    return out.reshape(-1, RANK + 1)


def _shortest_runs(label: np.ndarray, paragraph: np.ndarray) -> set[int]:
    """Subjects with a run of RUN sentences, or a shorter paragraph of two or more all of their own.

    Sentences without a subject (-1) neither make nor break a run.
    """
    known = label >= 0
    s, p = label[known], paragraph[known]
    if len(s) < 2:
        return set()
    edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    long = np.diff(edge) >= RUN
    found = set(s[edge[:-1][long]].tolist())
    edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
    sizes = np.bincount(paragraph - paragraph[0])
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if j - i >= 2 and s[i] not in found and 2 * (j - i) > sizes[p[i] - paragraph[0]] and (s[i:j] == s[i]).all():
            found.add(int(s[i]))
    return found


def subjects_of(
    documents: DataFrame,
    subjects: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_cosine: float = LEAST_COSINE,
    least_lead: float = LEAST_LEAD,
) -> DataFrame:
    """``id, subject``: one row for each subject a document is about; none, one or several.

    ``subjects`` names the subjects, ``labels`` (id, subject) some of them for
    some documents; letter case and repeats of labels do not matter, labels of
    other names or with nulls are left out.  Up to MAX_LABELS labelled documents
    are seeds; term statistics, singular vectors and the movement of centroids
    cover all documents.

    Null, empty and wordless texts are about nothing.  A subject without any
    label in a language is not found in that language.  Ids must be unique;
    rows with the same id and text give the same subjects once.
    """
    names: dict[str, str] = {}
    for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect():  # as many as there are centroids
        names[r[0].lower()] = min(r[0], names.get(r[0].lower(), r[0]))
    low = sorted(names)
    proper, number, count = [names[n] for n in low], {n: i for i, n in enumerate(low)}, len(low)
    kind = documents.schema[id_col].dataType.simpleString()
    spark = documents.sparkSession
    sentences = _sentences(documents, id_col, text_col)
    df, total, counted, together = _statistics(sentences)
    if not total.any() or not low:
        return spark.createDataFrame([], f"{id_col} {kind}, subject string")
    documents_of = np.repeat(np.maximum(total, 2), LANGUAGE_TERMS)
    weight = np.where(df > 0, np.log(documents_of / np.maximum(df, 1)), 0).clip(0).astype(np.float32)
    vectors, place = _singular_vectors(sentences, weight, df)
    terms = np.flatnonzero(df > 0)
    project = (vectors * weight[terms, None]).astype(np.float32)
    mean = np.zeros((len(LANGUAGES), RANK))
    np.add.at(mean, terms // LANGUAGE_TERMS, project * together[terms, None])
    blocks = _embedded(sentences, Model(project, place, (mean / np.maximum(counted, 1)[:, None]).astype(np.float32)), kind)

    wanted = subjects.select(F.lower("subject").alias("s")).where("s IS NOT NULL").distinct()
    usable = labels.select(F.col(id_col).alias("id"), F.lower(F.trim("subject")).alias("s")).where(F.col("id").isNotNull()).join(wanted, "s", "left_semi")
    chosen = usable.groupBy("id").agg(F.collect_set("s").alias("subjects")).orderBy("id").limit(MAX_LABELS).collect()
    seeds = spark.sparkContext.broadcast({r[0]: [number[x] for x in sorted(r[1]) if x in number] for r in chosen})

    def first(seeds: dict, ids: list, rest: bytes, x: bytes) -> np.ndarray:
        out = np.zeros((len(LANGUAGES) * count, RANK + 1))
        labelled = [d for d, i in enumerate(ids) if i in seeds]
        if labelled:
            document, _, language, x = _vectors_of(rest, x)
            for d in labelled:
                own = document == d
                for s in seeds[ids[d]]:
                    np.add.at(out, language[own] * count + s, np.c_[x[own], np.ones(int(own.sum()))] / len(seeds[ids[d]]))
        return out

    def nearest(m: Centroids, rest: bytes, x: bytes) -> np.ndarray:
        _, _, language, x = _vectors_of(rest, x)
        c = m.score(x, language)
        best = c.argmax(1)
        ok = _certain(c, best, least_cosine, least_lead)
        out = np.zeros((len(LANGUAGES) * count, RANK + 1))
        np.add.at(out, (language * count + best)[ok], np.c_[x[ok], np.ones(int(ok.sum()))])
        return out

    def settled(added: np.ndarray, before: Centroids | None) -> Centroids:
        full = np.zeros((len(LANGUAGES) * count, RANK + 1))
        full[: len(added)] = added
        c = full[:, :RANK] / np.maximum(np.linalg.norm(full[:, :RANK], axis=1, keepdims=True), 1e-9)
        c = c.reshape(len(LANGUAGES), count, RANK)
        filled = full[:, RANK].reshape(len(LANGUAGES), count) > 0
        if before is not None:  # a subject that attracted nothing stays where it was
            c = np.where(filled[:, :, None], c, before.centroid)
            filled = filled | before.usable
        return Centroids(c.astype(np.float32), filled)

    now = settled(_gather(blocks, seeds, first), None)
    for _ in range(MOST_ROUNDS):
        shared, before = spark.sparkContext.broadcast(now), now
        now = settled(_gather(blocks.select("rest", "x"), shared, nearest), before)
        shared.destroy()
        if (1 - (now.centroid * before.centroid).sum(2))[now.usable].max(initial=0) < STILL:
            break

    shared = spark.sparkContext.broadcast(now)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(0).type.value_type
            for ids, rest, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                document, paragraph, language, x = _vectors_of(rest, x)
                c = shared.value.score(x, language)
                best = c.argmax(1)
                label = np.where(_certain(c, best, least_cosine, least_lead), best, -1)
                edge = np.flatnonzero(np.r_[True, np.diff(document) != 0]) if len(label) else []
                found = [
                    (ids[document[i]], proper[s])
                    for i, j in zip(edge, [*edge[1:], len(label)], strict=True)
                    for s in sorted(_shortest_runs(label[i:j], paragraph[i:j]))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], id_type), pa.array([f[1] for f in found], pa.string())], names=["id", "subject"])

    return blocks.mapInArrow(assign, f"id {kind}, subject string").distinct().withColumnRenamed("id", id_col)


def _certain(c: np.ndarray, best: np.ndarray, least_cosine: float, least_lead: float) -> np.ndarray:
    top = c[np.arange(len(c)), best]
    if c.shape[1] == 1:
        return top >= least_cosine
    second = np.partition(c, -2, axis=1)[:, -2]
    return (top >= least_cosine) & (top - second >= least_lead)
