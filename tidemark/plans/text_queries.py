"""Text queries over documents and conversations.

The supplied texts are invented prose, so the word lists are fragments of that prose.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.columns import snap, unnest
from tidemark.functions import lexicons as lx
from tidemark.functions.text import clean_text
from tidemark.operators import entities as en
from tidemark.operators import relations as rl
from tidemark.operators import sentiment as se
from tidemark.plans.registry import query
from tidemark.plans.sql import snap as s
from tidemark.sources.tables import table

WORDS = {"company": ["License", "Copyright", "example"], "industry": ["blees", "reeaux"], "region": ["threre", "ouenai"], "executive": ["stre"]}
PATTERNS = {"percentage": lx.ENTITY_PATTERNS["percentage"], "date": lx.ENTITY_PATTERNS["date"], "stock": [r"\b\d{6}\b", "[A-Z]{2,6}"]}
CLEAN = r"""trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\x{4e00}-\x{9fa5}a-zA-Z0-9%$/\s.,;:!?()\[\]{}"''-]', '', 'g'))"""


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


def _extracted(spark, folder):
    return en.extract(_docs(spark, folder), "text", PATTERNS, WORDS)


_WORD_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{w}' AS text, '{k}' AS type, unnest(list_filter(range(length(t)), lambda i: substr(t, i + 1, {len(w)}) = '{w}')) AS start FROM c WHERE contains(t, '{w}')"
    for k, ws in WORDS.items()
    for w in ws
)


@query(
    "entity_words",
    f"""WITH c AS (SELECT doc_id, {CLEAN} AS t FROM documents), m AS ({_WORD_SQL}) SELECT doc_id, text, type, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end" FROM m""",
)
def entity_words(spark, folder):
    d = _docs(spark, folder).withColumn("t", clean_text(F.col("text")))
    out = unnest(d, ["doc_id"], en.word_mentions(F.col("t"), WORDS))
    return out.select("doc_id", "text", "type", "start", "end")


_PAT = [("percentage", r"[0-9]+(?:\.[0-9]+)?%"), ("date", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), ("date", r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"), ("stock", r"[A-Z]{2,6}")]
_PAT_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS type, unnest(f) AS text, unnest(list_transform(f, lambda x, i: list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0))) AS start
    FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS f, regexp_split_to_array(t, '{p}') AS p FROM c)"""
    for k, p in _PAT
)


@query(
    "entity_patterns",
    f"""WITH c AS (SELECT doc_id, {CLEAN} AS t FROM documents), m AS ({_PAT_SQL}) SELECT doc_id, text, type, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end" FROM m""",
)
def entity_patterns(spark, folder):
    patterns = {"percentage": PATTERNS["percentage"], "date": PATTERNS["date"][1:3], "stock": ["[A-Z]{2,6}"]}
    d = _docs(spark, folder).withColumn("t", clean_text(F.col("text")))
    out = unnest(d, ["doc_id"], en.pattern_mentions(F.col("t"), patterns))
    return out.select("doc_id", "text", "type", "start", "end")


@query("entity_extraction")
def entity_extraction(spark, folder):
    return en.mention_rows(_extracted(spark, folder), "doc_id")


@query("entity_statistics")
def entity_statistics(spark, folder):
    return en.extraction_statistics(en.mention_rows(_extracted(spark, folder), "doc_id"))


REL_PATTERNS = [("owns", "(.+?)tional(.+?)", 0.9, False, (), ()), ("competes_with", "(.+?)with(.+?)ouou", 0.8, True, ("company", "stock"), ())]
REL_KEYWORDS = {"controls": ["thewh", "onesen"], "mentions": ["iereu", "tionha"]}


@query("relation_extraction")
def relation_extraction(spark, folder):
    out = rl.extract_relations(_extracted(spark, folder), "doc_id", REL_PATTERNS, REL_KEYWORDS)
    return out.withColumn("evidence", F.array_join("evidence", ","))


@query("relation_search")
def relation_search(spark, folder):
    out = rl.extract_relations(_extracted(spark, folder), "doc_id", [], REL_KEYWORDS)
    merged = rl.merge_relations(out.withColumn("evidence", F.explode("evidence")))
    return rl.search_relations(merged, types=["controls", "competes_with", "located_in"], limit=20).withColumn("evidence", F.array_join("evidence", ","))


# the default tables are Chinese: each text is followed by one sentence, chosen by its id
SENTENCES = [
    "贵州茅台拥有招商银行", "平安银行控制中国平安，涨幅12.5%", "招商银行与平安银行竞争，股价大涨", "位于北京的比亚迪投资宁德时代",
    "中国平安与招商银行合作，业绩增长", "600519属于白酒行业", "董事长张三管理贵州茅台", "宁德时代影响新能源，风险上升，股价下跌",
]


def _with_sentences(spark, folder):
    said = F.element_at(F.array(*[F.lit(x) for x in SENTENCES]), (F.pmod("doc_id", F.lit(len(SENTENCES))) + 1).cast("int"))
    return _docs(spark, folder).withColumn("text", F.concat_ws(" 。", "text", said))


@query("entity_default_tables")
def entity_default_tables(spark, folder):
    return en.mention_rows(en.extract(_with_sentences(spark, folder)), "doc_id")


@query("relation_default_tables")
def relation_default_tables(spark, folder):
    out = rl.extract_relations(en.extract(_with_sentences(spark, folder)), "doc_id")
    return out.withColumn("evidence", F.array_join("evidence", ","))


LEXICON = {
    "positive": ["the", "la", "and"],
    "negative": ["of", "un", "der"],
    "weighted": {"tion": 2.0, "ment": -1.5},
    "degrees": {"in": 2.0, "on": 0.5, "le": 1.5},
    "negations": ["is", "de", "a"],
}
_BASE = "CASE WHEN w IN ('the', 'la', 'and') THEN 1.0 WHEN w IN ('of', 'un', 'der') THEN -1.0 WHEN w = 'tion' THEN 2.0 WHEN w = 'ment' THEN -1.5 END"
_NEG = "('is', 'de', 'a')"
_NUM = r"regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)%', 1)"


def _senti(src: str, key: str) -> str:
    return f"""tk AS (SELECT {key} AS k, unnest(l) AS w, unnest(list_prepend('', l[:-2])) AS b1, unnest(list_prepend('', list_prepend('', l[:-3]))) AS b2 FROM (SELECT {key}, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]+|[a-zA-Z]+|[0-9]+') AS l FROM {src}) WHERE len(l) > 2),
    hit AS (SELECT k, {_BASE}::DOUBLE * CASE b1 WHEN 'in' THEN 2.0 WHEN 'on' THEN 0.5 WHEN 'le' THEN 1.5 ELSE 1.0 END * CASE WHEN b1 IN {_NEG} OR b2 IN {_NEG} THEN -1 ELSE 1 END AS part FROM tk WHERE {_BASE} IS NOT NULL),
    num AS (SELECT {key} AS k, unnest({_NUM})::DOUBLE AS v FROM {src}), parts AS (SELECT * FROM hit UNION ALL SELECT k, 0.8 * CASE WHEN v > 10 THEN 2 WHEN v > 5 THEN 1.5 ELSE 1 END FROM num),
    sc AS (SELECT d.{key} AS k, count(part) AS n, CASE WHEN count(part) > 0 THEN greatest(least(avg(part), 1), -1) ELSE 0 END AS score FROM {src} d LEFT JOIN parts ON parts.k = d.{key} GROUP BY 1),
    lb AS (SELECT *, CASE WHEN score >= 0.6 THEN 'very_positive' WHEN score >= 0.2 THEN 'positive' WHEN score <= -0.6 THEN 'very_negative' WHEN score <= -0.2 THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN n > 0 THEN least(abs(score) + 0.3, 1) ELSE 0.3 END AS confidence FROM sc)"""




def lexicon():
    return se.Lexicon(LEXICON["positive"], LEXICON["negative"], [], LEXICON["weighted"], LEXICON["degrees"], LEXICON["negations"], [(r"(\d+(?:\.\d+)?)%", 0.8)])


def _scores(spark, folder):
    return se.lexicon_sentiment(_docs(spark, folder), "doc_id", "text", lexicon())


@query(
    "sentiment_lexicon",
    f"WITH {_senti('documents', 'doc_id')} SELECT k AS doc_id, {s('score')} AS score, label, {s('confidence')} AS confidence FROM lb",
)
def sentiment_lexicon(spark, folder):
    out = _scores(spark, folder)
    return out.select("doc_id", snap(F.col("score")).alias("score"), "label", snap(F.col("confidence")).alias("confidence"))


@query("sentiment_anywhere")
def sentiment_anywhere(spark, folder):
    return se.lexicon_sentiment(_docs(spark, folder), "doc_id", "text", lexicon(), anywhere=True)


_LABEL2 = "CASE WHEN {0} >= 0.6 THEN 'very_positive' WHEN {0} >= 0.2 THEN 'positive' WHEN {0} <= -0.6 THEN 'very_negative' WHEN {0} <= -0.2 THEN 'negative' ELSE 'neutral' END"


@query(
    "sentiment_combined",
    f"""WITH {_senti('documents', 'doc_id')}, q AS (SELECT doc_id, quality * 2.0 - 1 AS q FROM labels),
    c AS (SELECT lb.k AS doc_id, CASE WHEN q IS NULL THEN score ELSE (score * 0.6 * confidence + q * 0.4 * 0.5) / (0.6 * confidence + 0.4 * 0.5) END AS score, CASE WHEN q IS NULL THEN confidence ELSE (confidence + 0.5) / 2 END AS confidence FROM lb LEFT JOIN q ON q.doc_id = lb.k),
    j AS (SELECT c.*, CASE WHEN contains(text, 'License') THEN 1 WHEN contains(text, 'stre') THEN -1 ELSE 0 END AS side, {_LABEL2.format('score')} AS label FROM c JOIN documents USING (doc_id)),
    a AS (SELECT *, CASE WHEN side > 0 THEN greatest(score, 0.8) WHEN side < 0 THEN least(score, -0.8) ELSE score END AS new FROM j)
    SELECT doc_id, {s('new')} AS score, CASE WHEN side > 0 AND new > 0.8 THEN 'very_positive' WHEN side < 0 AND new < -0.8 THEN 'very_negative' ELSE label END AS label, {s('CASE WHEN side <> 0 THEN least(confidence + 0.2, 1) ELSE confidence END')} AS confidence FROM a""",
)
def sentiment_combined(spark, folder):
    """Lexicon result with the quality labels as a second opinion, then strong signals."""
    second = table(spark, folder, "labels").select("doc_id", (F.col("quality") * 2.0 - 1).alias("score"), F.lit(0.5).alias("confidence"))
    both = se.combine([(_scores(spark, folder), 0.6), (second, 0.4)], "doc_id")
    out = se.adjust_strong(both.join(_docs(spark, folder), "doc_id"), "text", [("License", 1), ("stre", -1)])
    return out.select("doc_id", snap(F.col("score")).alias("score"), "label", snap(F.col("confidence")).alias("confidence"))


@query(
    "sentiment_distribution",
    f"WITH {_senti('documents', 'doc_id')}, l AS (SELECT unnest(['very_negative', 'negative', 'neutral', 'positive', 'very_positive']) AS label) SELECT l.label, count(k) AS documents, {s('count(k)::DOUBLE / (SELECT count(*) FROM lb)')} AS share FROM l LEFT JOIN lb ON lb.label = l.label GROUP BY 1",
)
def sentiment_distribution(spark, folder):
    return se.distribution(_scores(spark, folder)).withColumn("share", snap(F.col("share")))


@query(
    "sentiment_trend",
    f"""WITH cv AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS id, * FROM conversations), {_senti('cv', 'id')},
    t AS (SELECT role, turn, avg(score) AS score FROM lb JOIN cv ON cv.id = lb.k GROUP BY 1, 2), m AS (SELECT *, avg(score) OVER (PARTITION BY role ORDER BY turn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM t)
    SELECT role, {s('arg_max(m, turn) - arg_min(m, turn)')} AS trend, {s('min(score)')} AS min_score, {s('max(score)')} AS max_score, {s('avg(score)')} AS avg_score, {s('arg_max(score, turn)')} AS latest_score,
      CASE WHEN arg_max(m, turn) - arg_min(m, turn) > 0.1 THEN 'positive' WHEN arg_max(m, turn) - arg_min(m, turn) < -0.1 THEN 'negative' ELSE 'stable' END AS direction FROM m GROUP BY 1""",
)
def sentiment_trend(spark, folder):
    """Mean score per role and turn; the series is as long as the longest talk."""
    talks = table(spark, folder, "conversations").withColumn("id", F.struct("conv_id", "turn", "role", "text"))
    scores = se.lexicon_sentiment(talks, "id", "text", lexicon())
    series = scores.groupBy("id.role", "id.turn").agg(F.avg("score").alias("score"))
    out = se.trend(series, ["role"], "turn")
    return out.select("role", *[snap(F.col(c)).alias(c) for c in ("trend", "min_score", "max_score", "avg_score", "latest_score")], "direction")


EMOTION_WORDS = {"joy": ["eaux", "tional"], "fear": ["hesh", "stre"], "trust": ["License", "ement"]}


@query(
    "sentiment_emotions",
    f"""WITH c AS (SELECT doc_id, {', '.join(f"({' + '.join(f'contains(text, {chr(39)}{w}{chr(39)})::INT' for w in ws)})::DOUBLE AS {e}" for e, ws in EMOTION_WORDS.items())} FROM documents), t AS (SELECT *, joy + fear + trust AS n FROM c),
    r AS (SELECT doc_id, CASE WHEN n > 0 THEN joy / n ELSE 0 END AS joy, CASE WHEN n > 0 THEN fear / n ELSE 0 END AS fear, CASE WHEN n > 0 THEN trust / n ELSE 0 END AS trust FROM t)
    SELECT doc_id, {s('joy')} AS joy, {s('fear')} AS fear, {s('trust')} AS trust, CASE WHEN joy >= fear AND joy >= trust THEN 'joy' WHEN fear >= trust THEN 'fear' ELSE 'trust' END AS dominant, {s('greatest(joy, fear, trust)')} AS intensity FROM r""",
)
def sentiment_emotions(spark, folder):
    out = se.emotions(_docs(spark, folder), "doc_id", "text", EMOTION_WORDS)
    return out.withColumns({c: snap(F.col(c)) for c in ("joy", "fear", "trust", "intensity")})
