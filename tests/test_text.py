import random
import re
import uuid

from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def plain_tokens(text):
    out, run = [], ""

    def flush():
        nonlocal run
        out.extend([*run, *(run[i : i + 2] for i in range(len(run) - 1))])
        run = ""

    for m in re.finditer(r"[A-Za-z0-9]+|[一-鿿]+", text):
        if "一" <= m[0][0] <= "鿿":
            run = m[0]
            flush()
        else:
            out.append(m[0].lower())
    return [t for t in out if not t.isdigit() and t not in T.INDEX_STOP_WORDS]


def test_index_tokens_against_plain_version(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Z9,的员工考勤 -x") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "水泵x9维修单 备件,仓库a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.index_tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r.x == plain_tokens(texts[r.i])
    assert one(spark, None, T.index_tokens) == []


def test_clean(spark):
    cases = {
        "a  b\t c": "a b c",
        "Annual Report\nBody text here.": "Body text here.",
        "x.\n\n\n\n\ny.": "x.\n\ny.",
        "k.<!-- no\nnote -->\n![pic](u.png) end.": "k.\nend.",
        "one.\n---\ntwo.\nPage 3 of 9\n- 4 -\n5\nthree.": "one.\n\ntwo.\n\nthree.",
        "t.\n```py\nx   =  1\n\n\n\n```\nz.": "t.\n```py\nx   =  1\n\n\n\n```\nz.",
        "": "",
        "Rapport été": "",
    }
    for text, want in cases.items():
        assert one(spark, text, T.clean) == want, text


def test_clean_leaves_what_is_no_noise(spark):
    cases = {
        "Plain sentence with 12 words.": "Plain sentence with 12 words.",
        "a - b\n-- not a rule": "a - b\n-- not a rule",
        "x.\n* * *\ny.": "x.\n* * *\ny.",
        "x.\n***\ny.": "x.\n\ny.",
        "Page one of two": "",
        "page 12\nlow case stays.": "low case stays.",
        "— 7 —\nend.": "end.",
        "a <!-- x --> b <!-- y --> c": "a b c",
        "keep [link](u) but ![no](u)": "keep [link](u) but",
        "tabs\there \n and   ends \t": "tabs here\nand ends",
        "```\n# code\n\n\n\n---\n```": "```\n# code\n\n\n\n---\n```",
        "中文 页眉": "中文 页眉",
    }
    for text, want in cases.items():
        assert one(spark, text, T.clean) == want, text


def test_truncate_first_line_sentences(spark):
    assert one(spark, "abcdef", lambda c: T.truncate(c, 4)) == "abc…"
    assert one(spark, "ab def", lambda c: T.truncate(c, 4)) == "ab…"
    assert one(spark, "abcd", lambda c: T.truncate(c, 4)) == "abcd"
    assert one(spark, " \n\n  x y \n z", T.first_line) == "x y"
    assert one(spark, " \n ", T.first_line) is None
    assert one(spark, "A b. C d! 好。\nE", T.sentences) == ["A b.", "C d!", "好。", "E"]
    assert one(spark, "[IMAGE: a1] x [IMAGE:b] [IMAGE: a1 ]", T.image_mentions) == ["a1", "b", "a1"]
    assert one(spark, "```json\n{}\n```", T.strip_code_fence) == "{}"
    assert one(spark, " DOC_ID : x1 ", T.is_marker) is True
    assert one(spark, "doc_id: x y", T.is_marker) is False


def test_ids(spark):
    name = "collection:default"
    assert one(spark, name, lambda c: ids.uuid5(ids.NAMESPACE_URL, c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, "x", lambda c: ids.store_name(c)) == "coll_" + uuid.uuid5(uuid.NAMESPACE_URL, "x").hex
    assert one(spark, "a/b\\c.md", ids.safe_filename) == "b_c.md"
    assert one(spark, "a/..", ids.safe_filename) == "upload.bin"
    wide = spark.createDataFrame([("d", 12345, "t"), ("d", 7, "t"), ("d", None, "t")], "d string, i int, t string").select(ids.chunk_id(F.col("d"), F.col("i"), F.col("t")).alias("x")).collect()
    assert [(r.x or "").rsplit("_", 1)[0] for r in wide] == ["d_12345", "d_0007", ""]
    got = spark.range(1).select(ids.batches(F.lit(5), 2).alias("b"), ids.wire_time(F.lit(1.9996)).alias("t")).first()
    assert [tuple(x) for x in got.b] == [(0, 2), (2, 4), (4, 5)]
    assert got.t == "1970-01-01T00:00:01.999Z"
