import uuid

import pytest
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).first()["r"]


def pairs(spark, content, translation):
    r = one(spark, S.align_pairs(S.source_values(F.col("c")), S.translation_values(F.col("t"))), c=content, t=translation)
    return r["reason"], r["pairs"] and [(p["raw"], p["norm"], p["original"], p["translation"]) for p in r["pairs"]]


def test_alignment_by_order_skips_blanks(spark):
    reason, found = pairs(spark, '[" 甲 ","","！！！","□□□","乙"]', '["译甲","！！！","原文残缺","译乙"]')
    assert reason is None
    assert [(f"1:{p[0]}:{p[1]}:{p[3]}") for p in found if p[2] != "！！！"] == ["1:0:0:译甲", "1:3:2:原文残缺", "1:4:3:译乙"]


def test_alignment_by_place(spark):
    assert pairs(spark, '["甲","","乙"]', '["译甲","","译乙"]') == (None, [(0, 0, "甲", "译甲"), (2, 1, "乙", "译乙")])


@pytest.mark.parametrize("content,translation,reason", [('["甲","乙"]', '["译甲"]', "counts differ"), ('["甲"] x', '["译甲"]', "unreadable"), ('["", " "]', '["译甲"]', "source is empty"), ('["甲"]', '[""]', "translation is empty"), ('["甲"]', '["a", null]', "unreadable"), ('["甲"]', "[]", "unreadable")])
def test_alignment_refuses(spark, content, translation, reason):
    assert pairs(spark, content, translation) == (reason, None)


def test_scalar_text_is_one_line(spark):
    assert pairs(spark, "独坐异乡", '["一个人身处异乡"]') == (None, [(0, 0, "独坐异乡", "一个人身处异乡")])


def test_point_id_is_uuid5(spark):
    name = "v1:tangsong:7:2:1"
    assert one(spark, S.point_id(S.POINT_NAMESPACE, F.col("n")), n=name) == str(uuid.uuid5(uuid.UUID(S.POINT_NAMESPACE), name)) == "a118c345-2319-5907-aa39-2e047233f3e1"


@pytest.mark.parametrize("text,good", [("poems:1", True), ("poems", False), ("poems:0", False), ("poems:01", False)])
def test_work_ids_are_written_plainly(spark, text, good):
    assert (one(spark, S.parse_work_id(F.col("t")), t=text) is not None) == good


RESPONSES = [
    ('{"2":"b说","1":"a说"}', ["甲句", "乙句"], None),
    ('["一行"]', ["甲句", "乙句"], "line count"),
    ("[]", ["甲"], "no translation"),
    ('["关关雎鸠"]', ["关关雎鸠"], "identical"),
    ('{"1":"。"}', ["。"], None),
    ('["空山新雨后，天气晚来秋。"]', ["□□□□□，□□□□□。"], "placeholder not explained"),
    ('["此处原文缺失，具体内容无法辨认。"]', ["□□□□□，□□□□□。"], None),
    ('["无法翻译"]', ["古文"], "refusal"),
    ('["太短"]', ["这是一句非常长的原文，译文不应只有两个字。"], "too short"),
]


@pytest.mark.parametrize("answer,source,reason", RESPONSES)
def test_responses(spark, answer, source, reason):
    r = one(spark, S.parse_response(F.col("s"), F.col("p")), s=source, p=f'x {{"translation": {answer}, "interpretation": "说明"}} y')
    assert (r["reason"], r["status"]) == (reason, "failed" if reason else "done")


def test_chunks_keep_order_and_limits(spark):
    lines = ["x" * (k % 37) for k in range(60)]
    spans = one(spark, S.chunk_lines(F.col("l"), 8, 100), l=lines)
    parts = [lines[s["from"] - 1 : s["to"]] for s in spans]
    assert sum(parts, []) == lines
    assert all(len(p) <= 8 and (len(p) == 1 or sum(map(len, p)) <= 100) for p in parts)
    assert [len(lines[s["from"] - 1 : s["to"]]) for s in one(spark, S.chunk_lines(F.col("l"), 8, 600), l=["字"] * 21)] == [8, 8, 5]


def test_part_values(spark):
    for part, count, want in [(None, None, (1, 1)), ("2.0", "3", (2, 3)), ("2", None, None), ("4", "3", None), ("0", "3", None)]:
        r = spark.range(1).select(S.part_values(F.lit(part).cast("string"), F.lit(count).cast("string")).alias("r")).first()["r"]
        assert (r and tuple(r)) == want


def test_maps_within_lines(spark):
    cases = {
        """["{'甲句': '第一句', '乙句': ' 第二句 '}"]""": ["第一句", "第二句"],
        """["a", "{\\"x\\": \\"b\\", \\"y\\": \\"\\"}"]""": ["a", "b"],
        """[{"x": "a"}, "b"]""": ["a", "b"],
        """{"2": "b", "1": "{'x': 'a'}"}""": ["a", "b"],
        """["{no map}"]""": ["{no map}"],
        """["{}"]""": ["{}"],
        """{"2": "b"}""": None,
        """[" "]""": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r["j"]: r["l"] for r in df.select("j", S.normalize_translation(F.col("j")).alias("l")).collect()} == cases
