"""Column functions of the corpus jobs: text, JSON, alignment, identifiers, translation checks.

All are built-in expressions, so a projection of any of them stays in one stage. Null input gives null
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that refuse to translate, and words by which a short explanation refuses.
REFUSALS = ("无法翻译", "无法译出", "原文残缺，无法翻译")
REFUSAL_WORDS = ("无法进行", "无法解读", "无法提供")
#: Signs for lost characters, and words that explain them.
PLACEHOLDERS = "□■�"
EXPLAINED = ("原文", "此处", "空白", "空缺", "缺失", "无法辨认", "省略", "缺字符号", "空格", "提供")
#: Fields that title and author are taken from, in order.
TITLE_FIELDS = ("title", "rhythmic", "chapter", "subchapter", "section", "book_title")
AUTHOR_FIELDS = ("author", "book_author")
#: Fixed value: the namespace of point ids.
POINT_NAMESPACE = "cc0fab8e-ff7c-49f2-809d-d96a73b5e4fc"
#: Parts of messages that tell of load, and of content that is refused for good.
LOAD_MARKERS = ("429", "rate limit", "connection error", "temporarily unavailable", "速率限制")
SKIP_MARKERS = ("contentfilter", '"code": "1301"', "'code': '1301'", "不安全或敏感内容")
#: The counts of each engine that are low enough to ask again.
LOW_COUNTS = {"baidu": (0, 100), "google": (0, 500), "bing": (0, 200), "bing_en": (0, 200), "so360": (0, 200)}


def trim_all(text: Column) -> Column:
    """Without white space at either end, whatever its Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def normalize_name(name: Column) -> Column:
    """A field name of letters, digits and underscores; `id` becomes original_id, a leading digit gets f_."""
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")
    return F.when(name == "id", F.lit("original_id")).when(clean.rlike(r"^\p{N}"), F.concat(F.lit("f_"), clean)).otherwise(clean)


def strict_json(text: Column) -> Column:
    """Whether a text is one whole JSON value; text after it doesn't pass, unlike in from_json."""
    rest = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "s")
    depth = F.length(F.regexp_replace(rest, r"[^\[{]", "")) - F.length(F.regexp_replace(rest, r"[^\]}]", ""))
    closed = ~rest.rlike(r"[\]}]\s*[^\s,\]}]") & ~rest.rlike(r"^\s*[^\s\[{].*\s+\S")
    return F.try_parse_json(text).isNotNull() & (depth == 0) & closed


def source_values(text: Column) -> Column:
    """The lines of a content cell: of a JSON array its elements, of other JSON or text itself; none for blank.

    Null for what starts like an array and isn't whole JSON.
    """
    value = trim_all(text)
    array = value.startswith("[")
    listed = F.when(strict_json(value), F.from_json(value, "array<string>"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).when(array, listed).otherwise(F.array(value))


def normalized_source(values: Column) -> Column:
    """(text, raw) of the values that aren't blank, trimmed, with their places."""
    placed = F.transform(values, lambda x, k: F.struct(trim_all(F.coalesce(x, F.lit(""))).alias("text"), k.alias("raw")))
    return F.filter(placed, lambda p: p["text"] != "")


def translation_values(text: Column) -> Column:
    """The trimmed elements of a JSON array of strings; null if it is anything else, empty, or holds a null."""
    value = F.try_parse_json(text)
    listed = F.from_json(text, "array<string>")
    good = (F.schema_of_variant(value) == "ARRAY<STRING>") & strict_json(text) & (F.size(listed) > 0) & ~F.exists(listed, lambda x: x.isNull())
    return F.when(good, F.transform(listed, trim_all))


def align_pairs(source: Column, translation: Column) -> Column:
    """(reason, pairs): pairs (raw, norm, original, translation) of lines with their translations.

    Of as many translations as lines, each belongs to the line in its place and blank lines are skipped;
    of as many as lines that aren't blank, to these in order. Anything else has a reason instead.
    """

    def made(x: Column) -> Column:
        lines, told, kept = x["source"], x["translation"], x["kept"]
        by_place = F.size(lines) == F.size(told)
        by_order = F.size(kept) == F.size(told)
        pairs = F.transform(
            kept,
            lambda p, k: F.struct(p["raw"].cast("long").alias("raw"), k.cast("long").alias("norm"), p["text"].alias("original"), trim_all(F.get(told, F.when(by_place, p["raw"]).otherwise(k))).alias("translation")),
        )
        reason = F.when(lines.isNull() | told.isNull(), "unreadable").when(F.size(kept) == 0, "source is empty").when(~(by_place | by_order), "counts differ")

        def checked(found: Column) -> Column:
            empty = F.exists(found, lambda p: F.coalesce(p["translation"], F.lit("")) == "")
            return F.struct(F.coalesce(reason, F.when(empty, "translation is empty")).alias("reason"), F.when(reason.isNull() & ~empty, found).alias("pairs"))

        return let(pairs, checked)

    # Bound once, so that no lambda computes them again for each line.
    return let(F.struct(source.alias("source"), translation.alias("translation"), normalized_source(source).alias("kept")), made)


def indexable(original: Column, translation: Column) -> Column:
    """Whether a pair holds any letter or number."""
    return F.regexp_like(F.concat(original, translation), F.lit(r"[\p{L}\p{N}]"))


def positive_integer(value: Column) -> Column:
    """A positive whole number from a number or text such as 2, 2.0 or '2'; null otherwise."""
    n = value.try_cast("double")
    return F.when((n >= 1) & (n == F.floor(n)) & (n < 2**53), n.cast("long"))


def part_values(part: Column, count: Column) -> Column:
    """(part, count): (1, 1) without both; null for only one, or a part beyond the count."""
    p, c = positive_integer(part), positive_integer(count)
    return F.when(part.isNull() & count.isNull(), F.struct(F.lit(1).cast("long").alias("part"), F.lit(1).cast("long").alias("count"))).when(p <= c, F.struct(p.alias("part"), c.alias("count")))


def work_id(dataset: Column, first_row: Column) -> Column:
    return F.concat_ws(":", dataset, first_row.cast("string"))


def locator_key(row: Column, raw: Column, norm: Column) -> Column:
    return F.concat_ws(":", row.cast("string"), raw.cast("string"), norm.cast("string"))


def parse_work_id(text: Column) -> Column:
    """(dataset, row) of `dataset:n`; null unless n is a positive whole number written plainly."""
    dataset, n = F.regexp_extract(text, r"^([^:]+):(\d+)$", 1), F.regexp_extract(text, r"^([^:]+):(\d+)$", 2).try_cast("long")
    return F.when((dataset != "") & (n > 0) & (work_id(dataset, n) == text), F.struct(dataset.alias("dataset"), n.alias("row")))


def point_id(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def query_key(profile: Column, query: Column) -> Column:
    """The identity of a query under a profile."""
    return F.sha2(F.concat(F.encode(profile, "UTF-8"), F.unhex(F.lit("00")), F.encode(query, "UTF-8")), 256)


def parse_content(text: Column) -> Column:
    """Trimmed lines of a JSON list that aren't blank; text that is no list is one line."""
    listed = F.from_json(text, "array<string>")
    lines = F.filter(F.transform(listed, trim_all), lambda x: x != "")
    whole = F.filter(F.array(trim_all(text)), lambda x: x != "")
    return F.when(trim_all(text).startswith("[") & F.try_parse_json(text).isNotNull(), lines).otherwise(whole)


def is_punctuation_only(text: Column) -> Column:
    return text.rlike(r"(?U)^[\p{P}\p{S}\s]+$") & (trim_all(text) != "")


def is_placeholder_only(text: Column) -> Column:
    return is_punctuation_only(text) & text.rlike(f"[{PLACEHOLDERS}]")


def chunk_lines(lines: Column, most_lines: int, most_chars: int) -> Column:
    """Greedy chunks (from, to) over lines: at most so many lines and characters; a longer line stays alone. from counts from 1."""
    start = F.struct(F.array().cast("array<struct<from:int,to:int>>").alias("done"), F.lit(1).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("chars"))

    def step(a: Column, line: Column) -> Column:
        size = F.length(F.coalesce(line, F.lit("")))
        full = (a["k"] + 1 - a["at"] >= most_lines) | (a["chars"] + size > most_chars)
        cut = full & (a["k"] >= a["at"])
        span = F.struct(a["at"].alias("from"), a["k"].alias("to"))
        return F.struct(
            F.when(cut, F.concat(a["done"], F.array(span))).otherwise(a["done"]).alias("done"),
            F.when(cut, a["k"] + 1).otherwise(a["at"]).alias("at"),
            (a["k"] + 1).alias("k"),
            F.when(cut, size).otherwise(a["chars"] + size).alias("chars"),
        )

    def finish(a: Column) -> Column:
        return F.when(a["k"] >= a["at"], F.concat(a["done"], F.array(F.struct(a["at"].alias("from"), a["k"].alias("to"))))).otherwise(a["done"])

    return F.aggregate(lines, start, step, finish)


def refuses(lines: Column) -> Column:
    """Whether a line is nothing but a refusal and its punctuation."""
    return F.exists(lines, lambda x: F.regexp_replace(x, "^[ 。；;，,：（）()]+|[ 。；;，,：（）()]+$", "").isin(*REFUSALS))


def interpretation_refuses(text: Column) -> Column:
    return (F.length(text) <= 40) & text.rlike("|".join(REFUSAL_WORDS))


def extract_json(text: Column) -> Column:
    """The text itself if it is JSON, else what lies from its first { to its last }; null if that isn't JSON."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def normalize_translation(json: Column) -> Column:
    """Lines of a translation given as text, list, or map with the keys 1 to n; null if none or the keys are others.

    A line that is itself a map, as JSON or with single quotes, gives its values in their order.
    """
    def keyed(text: Column) -> Column:
        entries = F.array_sort(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v"))))
        return let(entries, lambda es: F.when(F.transform(es, lambda e: e["k"]) == F.sequence(F.lit(1), F.greatest(F.size(es), F.lit(1))), F.transform(es, lambda e: e["v"])))

    listed = let(F.schema_of_variant(F.try_parse_json(json)), lambda kind: F.when(kind.startswith("ARRAY"), F.from_json(json, "array<string>")).when(kind.startswith("OBJECT"), keyed(json)).when(kind == "STRING", F.array(F.try_variant_get(F.try_parse_json(json), "$", "string"))))

    def opened(line: Column) -> Column:
        inner = F.when(line.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(line, "map<string,string>"))
        return let(inner, lambda m: F.when(F.size(m) > 0, F.map_values(m)).otherwise(F.array(line)))

    kept = F.filter(F.transform(F.flatten(F.transform(listed, opened)), trim_all), lambda x: x != "")
    return let(kept, lambda lines: F.when(F.size(lines) > 0, lines))


def translation_quality(source: Column, translation: Column) -> Column:
    """The first reason against a translation, null if there is none."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"(?U)\s", "")))

    def judged(lines: Column) -> Column:
        unexplained = F.exists(F.zip_with(lines, translation, lambda s, t: is_placeholder_only(s) & (s != t) & ~t.rlike("|".join(EXPLAINED))), lambda x: x)
        return (
            F.when(F.size(lines) != F.size(translation), "line count")
            .when(unexplained, "placeholder not explained")
            .when((lines == translation) & F.exists(lines, lambda s: ~is_punctuation_only(s)), "identical")
            .when((total(lines) > 0) & (10 * total(translation) < 3 * total(lines)), "too short")
        )

    return let(F.transform(source, trim_all), judged)


def parse_response(source: Column, payload: Column) -> Column:
    """(status, translation, interpretation, reason) of a model's answer for lines of source; the first failing check counts.

    Each step is bound by let(), since a column named twice in an expression is computed twice.
    """
    def judged(found: Column) -> Column:
        lines, interpretation = found["lines"], found["interpretation"]
        reason = (
            F.when(~found["json"], "no JSON")
            .when(lines.isNull(), "no translation")
            .when(refuses(lines), "refusal")
            .otherwise(F.coalesce(translation_quality(source, lines), F.when(interpretation == "", "no interpretation").when(interpretation_refuses(interpretation), "interpretation refused")))
        )
        told = lambda why: F.struct(F.when(why.isNull(), "done").otherwise("failed").alias("status"), F.when(why.isNull(), lines).alias("translation"), F.when(why.isNull(), interpretation).alias("interpretation"), why.alias("reason"))
        return let(reason, told)

    def read(json: Column) -> Column:
        answer = F.to_json(F.try_variant_get(F.try_parse_json(json), "$.translation", "variant"))
        interpretation = F.coalesce(trim_all(F.get_json_object(json, "$.interpretation")), F.lit(""))
        return F.struct(json.isNotNull().alias("json"), let(answer, normalize_translation).alias("lines"), interpretation.alias("interpretation"))

    return let(let(extract_json(payload), read), judged)


def build_prompt(lines: Column, keys: Column) -> Column:
    """Numbered lines, and the keys that the answer must have."""
    numbered = F.transform(lines, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), F.to_json(x.cast("variant"))))
    return F.concat_ws("\n", F.array_join(numbered, "\n"), F.concat(F.lit("keys: "), F.array_join(keys, ",")))


def classify_failure(message: Column, status: Column) -> Column:
    """What kind of failure a message and an HTTP status tell of; the first that fits."""
    m = F.lower(message)

    def holds(parts: tuple[str, ...]) -> Column:
        return F.array_max(F.array(*[F.contains(m, F.lit(p)) for p in parts]))

    return (
        F.when(holds(SKIP_MARKERS), "skip")
        .when(holds(("timeout", "timed out")), "timeout")
        .when(holds(LOAD_MARKERS) | (status == 429), "load")
        .when(status.isin(408, 500, 502, 503, 504), "retry")
        .when((status >= 400) & (status < 500), "permanent")
        .otherwise("other")
    )


def html_result_count(html: Column, pattern: str) -> Column:
    """The first number that the pattern finds outside scripts and styles, without its commas; 0 if none."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return F.coalesce(F.regexp_replace(F.regexp_extract(plain, pattern, 1), ",", "").try_cast("long"), F.lit(0).cast("long"))


def url_escape(text: Column) -> Column:
    """Percent-encoded, with %20 for a space."""
    return F.regexp_replace(F.url_encode(text), r"\+", "%20")


def detail_url(work: Column, generation: Column) -> Column:
    return F.concat(F.lit("/works/"), url_escape(work), F.lit("?generation="), url_escape(generation))


def utc_parse(text: Column) -> Column:
    """A time written in ISO 8601 with Z or +00:00; null otherwise."""
    return F.when(text.rlike(r"(Z|[+]00:00)$"), F.try_to_timestamp(text))


def work_document(work_id_: Column, dataset: Column, title: Column, author: Column, original: Column, translation: Column, interpretations: Column) -> Column:
    """A work as JSON with exactly seven fields; lists are never null, the author may be."""

    def some(x: Column) -> Column:
        return F.coalesce(x, F.array().cast("array<string>"))

    fields = [work_id_.alias("work_id"), dataset.alias("dataset"), title.alias("title"), author.alias("author"), some(original).alias("original"), some(translation).alias("translation"), some(interpretations).alias("interpretations")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def first_filled(*columns: Column) -> Column:
    """The first of the columns that isn't blank."""
    return F.coalesce(*[F.when(trim_all(c) != "", trim_all(c)) for c in columns])


#: The fields of a work's document.
DOCUMENT_FIELDS = ("work_id", "dataset", "title", "author", "original", "translation", "interpretations")


def document_reason(json: Column) -> Column:
    """Why a work's document isn't valid, or null: exactly the seven fields, texts and lists, lines and translations as many."""
    kind = F.from_json(json, "struct<work_id:string,dataset:string,title:string,author:string,original:array<string>,translation:array<string>,interpretations:array<string>>")
    return (
        F.when(F.try_parse_json(json).isNull(), "no JSON")
        .when(F.coalesce(F.array_sort(F.json_object_keys(json)) != F.array(*map(F.lit, sorted(DOCUMENT_FIELDS))), F.lit(True)), "fields")
        .when(kind["work_id"].isNull() | kind["dataset"].isNull() | kind["title"].isNull(), "missing text")
        .when(kind["original"].isNull() | kind["translation"].isNull() | kind["interpretations"].isNull(), "missing list")
        .when(F.size(kind["original"]) != F.size(kind["translation"]), "counts differ")
    )
