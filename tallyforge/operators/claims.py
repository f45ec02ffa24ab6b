"""Claims mined from sentences, checked citations, and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

#: What makes a sentence a claim of a field.
FIELDS = {
    "pain": r"(?i)\b(?:leak|leaking|seep|fail(?:ed|ure)?|broke?n?(?!\s+in)|crack(?:ed)?|problem|issue|fit(?:ment)?|clearance|overheat|overheating|rust|expensive|returned|doesn['’]?t fit|didn['’]?t fit|worried|concerned)\b",
    "need": r"(?i)\b(?:i|we|my|our)\b.{0,100}\b(?:need|looking for|recommend|should i|want to|how do i|which|help me|trying to find|advice)\b|\b(?:need|looking for|recommend|should i|want to|how do i|which)\b.{0,100}\b(?:fit|kit|part|tuner|truck|help)\b",
    "current_solution": r"(?i)\b(?:i|we|my|our)\b.{0,100}\b(?:installed|installing|replaced|replace|bought|ordered|tried|used|running|oem|aftermarket|kit|tuner|tune|shop|dealer|weld|clamp)\b",
    "solution_gap": r"(?i)\b(?:i|we|my|our)\b.{0,100}\b(?:doesn['’]?t fit|didn['’]?t fit|no instructions?|missing|returned|failed again|poor quality|had to modify|hard to|unclear|not supported|not compatible|wrong part|extra work|redo)\b|\b(?:had to modify|no instructions?|missing|returned|failed again|not compatible|wrong part|extra work|redo)\b",
    "consequence": r"(?i)\b(?:stranded|downtime|tow truck|missed work|damage|unsafe|fire|cost me|lost money|ruined|breakdown|break down)\b",
}
NEGATED = r"(?i)\b(?:no|not|never|without)\s+(?:\w+\s+){0,2}(?:leak|rust|problem|issue|failure)\b"
FIRST_PERSON = r"(?i)\b(?:i|my|we|our)\b"
HIGH = r"(?i)stranded|fire|unsafe|overheat|breakdown|failed|broken|damage"
MEDIUM = r"(?i)leak|fit|install|rust|expensive|return|problem|issue"
BECAUSE = r"(?i)(?:because|so|which|causing|lead(?:s|ing)? to)\s+(.{10,120})"

#: What a claim's phrase captures after its field's words, the labels of claims that capture nothing, and how each field's phrase begins.
CAPTURE = {
    "need": (r"(?i)(?:need|looking for|want(?: to)?|recommend|which|how do i)\s+(.{3,70})", "用户希望获得：", ""),
    "current_solution": (r"(?i)(?:installed|installing|replaced|replace|bought|ordered|tried|used|running)\s+(.{3,70})", "用户已尝试：", ""),
    "solution_gap": (r"(?i)(?:missing|no instructions?|wrong part|had to modify|doesn['’]?t fit|didn['’]?t fit)\s*(.{0,60})", "用户指出方案缺口：", "适配或安装支持不足"),
}
LABELS = [
    (r"(?i)leak|seep", "泄漏或渗漏"),
    (r"(?i)fit|clearance|compatib|modify|wrong part", "安装适配或间隙不匹配"),
    (r"(?i)fail|broke?n?|broken|crack|overheat|breakdown", "故障、损坏或失效"),
    (r"(?i)problem|issue|concern|worried", "具体故障或问题"),
    (r"(?i)install|instruction|redo|extra work", "安装步骤或返工复杂"),
    (r"(?i)price|cost|expensive|money", "价格或维修成本"),
    (r"(?i)rust", "锈蚀和耐久性"),
    (r"(?i)egt|exhaust gas temperature|hot", "排温或热管理"),
]
LABEL_START = {"pain": "用户报告", "need": "用户希望", "current_solution": "用户已尝试", "solution_gap": "现有方案存在", "consequence": "可能后果"}
EXCERPT_START = {"pain": "用户报告具体问题", "need": "用户提出具体需求", "current_solution": "用户提到现有解决办法", "solution_gap": "用户指出方案缺口", "consequence": "用户提到后果"}


def phrase(field: Column, sentence: Column) -> Column:
    """A claim in short: what follows its field's words, else its subject's label, else its first 80 characters."""
    start = lambda d: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[field], F.lit("用户提到"))
    label = F.coalesce(*[F.when(sentence.rlike(p), F.lit(name)) for p, name in LABELS])
    plain = T.clip(sentence, 80)
    out = F.when(label.isNotNull(), F.concat(start(LABEL_START), label)).when(plain != "", F.concat(start(EXCERPT_START), F.lit("："), plain)).otherwise(start(EXCERPT_START))
    for name, (pattern, before, without) in CAPTURE.items():
        said = T.collapse(F.regexp_extract(sentence, pattern, 1))
        out = F.when((field == name) & sentence.rlike(pattern), F.concat(F.lit(before), F.when(said != "", said).otherwise(without))).otherwise(out)
    return out


def from_sentences(df: DataFrame) -> DataFrame:
    """A claim for each sentence and field it fits.  ``df``: post_id, evidence_id, author, text."""
    s = df.select("post_id", "evidence_id", "author", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    first = F.col("sentence").rlike(FIRST_PERSON)
    own = {
        "pain": F.col("sentence").rlike(FIELDS["pain"]) & ~F.col("sentence").rlike(NEGATED),
        "need": F.col("sentence").rlike(FIELDS["need"]) & first,
        **{k: F.col("sentence").rlike(FIELDS[k]) for k in ("current_solution", "solution_gap", "consequence")},
    }
    fields = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in own.items()]))
    x = s.withColumn("fields", fields).withColumn("status", F.when(first, "fact").otherwise("inference"))
    x = x.withColumn("severity", F.when(F.col("sentence").rlike(HIGH), "high").when(F.col("sentence").rlike(MEDIUM), "medium").otherwise("unknown"))
    after = F.regexp_extract("sentence", BECAUSE, 1)
    x = x.withColumn("consequence", F.when(after != "", T.collapse(after)).otherwise("unknown"))
    return x.select("post_id", "evidence_id", "author", "pos", F.explode_outer("fields").alias("field"), F.col("sentence").alias("source_text"), "status", "severity", "consequence").filter("field IS NOT NULL").withColumn("text", phrase(F.col("field"), F.col("source_text")))


def distinct(claims: DataFrame) -> DataFrame:
    """One claim for each field, text, evidence and sentence of a post; claims without evidence are dropped."""
    return claims.filter(F.col("evidence_id").isNotNull()).groupBy("post_id", "evidence_id", "field", "text", "source_text").agg(*[F.min(c).alias(c) for c in ("author", "pos", "status", "severity", "consequence")])


_RANK = {"unknown": 0, "medium": 1, "high": 2}


def aggregate(claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, field, text with counts of evidence, posts and authors, status (fact if all are), highest severity, the first consequence and the first sentence.

    ``by``: columns (such as a topic) within which claims add up.  The ids themselves are rows of ``evidence``, not a list.
    """
    level = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    order = F.struct("post_id", "evidence_id", "pos")
    keys = [*(by or []), "field", "text"]
    g = claims.groupBy(*keys).agg(
        F.count_distinct("post_id", "evidence_id").alias("frequency"), F.count_distinct("post_id").alias("n_posts"), F.count_distinct(T.blank_to_null(F.lower(F.trim("author")))).alias("n_authors"), F.min_by("source_text", order).alias("source_text"),
        F.bool_and(F.col("status") == "fact").alias("all_fact"), F.max(level).alias("level"), F.min_by("consequence", F.when(F.col("consequence") != "unknown", order)).alias("consequence"),
    )
    return g.select(*keys, "frequency", "n_posts", "n_authors", F.when(F.col("all_fact"), "fact").otherwise("inference").alias("status"), F.when(F.col("level") == 2, "high").when(F.col("level") == 1, "medium").otherwise("unknown").alias("severity"), F.coalesce("consequence", F.lit("unknown")).alias("consequence"), "source_text")


def opportunities(counted: DataFrame, by: list[str]) -> DataFrame:
    """by, text and counts: of each group in which a gap (two posts and authors) and a pain (two authors) repeat, the strongest gap."""
    gap = (F.col("field") == "solution_gap") & (F.col("n_posts") >= 2) & (F.col("n_authors") >= 2)
    strength = F.struct(-F.col("n_posts"), -F.col("frequency"), F.col("text"))
    g = counted.groupBy(*by).agg(F.min_by(F.struct("text", "frequency", "n_posts", "n_authors"), F.when(gap, strength)).alias("g"), F.bool_or((F.col("field") == "pain") & (F.col("n_authors") >= 2)).alias("pain"))
    return g.filter(F.col("pain") & F.col("g").isNotNull()).select(*by, "g.*")


def evidence(claims: DataFrame, known: DataFrame) -> DataFrame:
    """post_id, evidence_id, url: the distinct known evidence behind claims."""
    return claims.select("post_id", "evidence_id").distinct().join(known.select("post_id", "evidence_id", "url"), ["post_id", "evidence_id"]).filter(F.coalesce("url", F.lit("")) != "").distinct()


def checked(value: Column, ids: Column, status: Column, known: Column) -> Column:
    """A field as struct(value, evidence_ids, status): known citations in order; 'unknown' without any, or with another status."""
    kept = F.filter(ids, lambda x: F.array_contains(known, x))
    ok = status.isin("fact", "inference") & (F.size(kept) > 0) & (F.size(kept) == F.size(ids)) & (F.trim(value) != "")
    return F.struct(F.when(ok, value).otherwise("unknown").alias("value"), F.when(ok, kept).otherwise(F.array().cast("array<string>")).alias("evidence_ids"), F.when(ok, status).otherwise("unknown").alias("status"))


def cited(ids: Column, urls: Column, known: Column) -> Column:
    """Whether the ids are keys of the map ``known`` and their urls are exactly the given ones, in order."""
    return (F.size(ids) > 0) & F.forall(ids, lambda x: F.map_contains_key(known, x)) & F.coalesce(F.transform(ids, lambda x: F.element_at(known, x)) == urls, F.lit(False))


def merge_fields(df: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of an analysis merged: the first value, its spelling by order, all ids' count, the strongest status.  ``df``: keys, ord, value, evidence_id, status."""
    rank = F.when(F.col("status") == "fact", 2).when(F.col("status") == "inference", 1).otherwise(0)
    g = df.groupBy(*keys, F.lower(F.trim("value")).alias("k")).agg(F.min_by("value", "ord").alias("value"), F.count_distinct("evidence_id").alias("n_evidence"), F.max(rank).alias("r"), F.min("ord").alias("first"))
    return g.select(*keys, "k", "value", "n_evidence", "first", F.when(F.col("r") == 2, "fact").when(F.col("r") == 1, "inference").otherwise("unknown").alias("status"))
