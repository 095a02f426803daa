"""Answer parsing and text clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators import joins
from spanforge.operators import parsing as ps
from spanforge.operators.ordered import KEYS
from spanforge.plans.registry import query, with_ctes
from spanforge.sources import views
from spanforge.sources.views import ORDER_LINES, RANKING_ANSWERS, TASK_ITEMS

ORDER_CTES = (ORDER_LINES, TASK_ITEMS, RANKING_ANSWERS)


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


RANK_IDS = """
ids AS (SELECT video_id, n_items, raw_output,
  CASE WHEN regexp_matches(raw_output, '(?i)Shot\\s+\\d+') THEN regexp_extract_all(raw_output, '(?i)Shot\\s+(\\d+)', 1)
       ELSE regexp_extract_all(raw_output, '\\b(\\d+)\\b', 1) END AS said FROM ranking_answers),
judged AS (SELECT *, CASE WHEN trim(raw_output, ' \t\n') = '' THEN 'empty_output' WHEN len(said) = 0 THEN 'wrong_format'
  WHEN len(list_distinct(said)) < len(said) THEN 'duplicated_items' WHEN len(said) < n_items THEN 'missing_items' END AS failure_reason FROM ids)
"""


@query(
    "parse_ranking_reasoned",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        body="SELECT video_id, failure_reason, CASE WHEN failure_reason IS NULL THEN array_to_string(said, ',') END AS ranking FROM judged",
    ),
)
def parse_ranking_reasoned(spark, sf):
    out = ps.parse_ranking_reasoned(views.ranking_answers(spark, sf))
    return out.select("video_id", "failure_reason", joined("ranking").alias("ranking"))


@query(
    "parse_ranking_strict",
    with_ctes(
        *ORDER_CTES,
        """ids AS (SELECT video_id, n_items, regexp_extract_all(raw_output, '(?i)Shot\\s+(\\d+)', 1) AS said FROM ranking_answers)""",
        """firsts AS (SELECT video_id, any_value(n_items) AS n, string_agg(x, ',' ORDER BY p) AS r, count(*) AS k FROM
             (SELECT video_id, n_items, x, min(p) AS p FROM (SELECT video_id, n_items, unnest(said) AS x, generate_subscripts(said, 1) AS p FROM ids) GROUP BY ALL) GROUP BY video_id)""",
        body="SELECT i.video_id, CASE WHEN f.k = f.n THEN f.r END AS ranking FROM ids i LEFT JOIN firsts f USING (video_id)",
    ),
)
def parse_ranking_strict(spark, sf):
    out = ps.parse_ranking_strict(views.ranking_answers(spark, sf))
    return out.select("video_id", joined("ranking").alias("ranking"))


@query(
    "explode_predictions",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        body="""SELECT video_id, pos, CAST(x AS BIGINT) AS pred_id FROM (SELECT video_id, unnest(said) AS x, generate_subscripts(said, 1) AS pos
        FROM judged WHERE failure_reason IS NULL)""",
    ),
)
def explode_predictions(spark, sf):
    out = ps.explode_predictions(ps.parse_ranking_reasoned(views.ranking_answers(spark, sf)))
    return out.select("video_id", "pos", "pred_id")


@query(
    "completeness",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        body="""SELECT video_id, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') AS missing FROM
        (SELECT video_id, said, unnest(range(1, n_items + 1)) AS k FROM ids) WHERE NOT list_contains(said, CAST(k AS VARCHAR)) GROUP BY video_id""",
    ),
)
def completeness(spark, sf):
    a = views.ranking_answers(spark, sf)
    named = text.integers(F.col("raw_output"), r"(?i)Shot\s+(\d+)", 1)
    ids = F.when(F.size(named) > 0, named).otherwise(text.integers(F.col("raw_output"), r"\b(\d+)\b", 1))
    out = a.withColumn("missing", ps.missing_ids(ids, F.col("n_items")))
    return out.filter(F.size("missing") > 0).select("video_id", joined("missing").alias("missing"))


def pair_answers(spark, sf):
    """What a judge said about each pair, in clear and unclear forms."""
    pairs = joins.pair_rows(views.task_items(spark, sf))
    pairs = pairs.withColumn("_t", F.substring(F.md5(F.concat_ws("|", "video_id", "item_i", "item_j")), 1, 1))
    t = F.col("_t")
    better = F.when(F.col("score_i") >= F.col("score_j"), "A").otherwise("B")
    said = (
        F.when(t == "9", "Shot B looks better than Shot A")
        .when(t == "a", "shot a")
        .when(t == "b", "ShotB!")
        .when(t == "c", F.lit(None).cast("string"))
        .when(t == "d", "Shots are equal")
        .when(t == "e", F.concat(F.lit("**Shot\n"), better, F.lit("**")))
        .otherwise(F.concat(F.lit("Shot "), better))
    )
    return pairs.withColumn("raw_output", said).drop("_t")


PAIR_ANSWERS = """
pairs AS (SELECT a.dataset, a.video_id, row_number() OVER (PARTITION BY a.video_id ORDER BY a.orig_pos, b.orig_pos) - 1 AS pair_idx,
  a.orig_pos AS i, b.orig_pos AS j, CASE WHEN a.score >= b.score THEN 'A' ELSE 'B' END AS better,
  substr(md5(concat_ws('|', a.video_id, a.item_key, b.item_key)), 1, 1) AS t
  FROM task_items a JOIN task_items b ON a.video_id = b.video_id AND a.orig_pos < b.orig_pos),
pair_answers AS (SELECT *, CASE t WHEN '9' THEN 'Shot B looks better than Shot A' WHEN 'a' THEN 'shot a' WHEN 'b' THEN 'ShotB!' WHEN 'c' THEN NULL
  WHEN 'd' THEN 'Shots are equal' WHEN 'e' THEN '**Shot' || chr(10) || better || '**' ELSE 'Shot ' || better END AS raw_output FROM pairs),
winners AS (SELECT *, CASE
  WHEN regexp_matches(raw_output, '(?i)\\bShot\\s*A\\b') AND NOT regexp_matches(raw_output, '(?i)\\bShot\\s*B\\b') THEN 'A'
  WHEN regexp_matches(raw_output, '(?i)\\bShot\\s*B\\b') AND NOT regexp_matches(raw_output, '(?i)\\bShot\\s*A\\b') THEN 'B'
  ELSE nullif(upper(regexp_extract(raw_output, '(?i)\\bShot\\s*([AB])\\b', 1)), '') END AS winner FROM pair_answers)
"""


@query(
    "parse_winner",
    with_ctes(ORDER_LINES, TASK_ITEMS, PAIR_ANSWERS, body="SELECT video_id, pair_idx, winner FROM winners"),
)
def parse_winner(spark, sf):
    out = pair_answers(spark, sf)
    return out.select("video_id", "pair_idx", ps.parse_winner(F.col("raw_output")).alias("winner"))


def grounding_answers(spark, sf, head="Summary ", items=None):
    """Lines ``Summary K: Clip a, Clip b`` per order, some broken; n_lines lines, n_ids clips."""
    items = views.task_items(spark, sf) if items is None else items
    n = F.col("n_items")
    line = F.concat(
        F.lit(head),
        F.col("display_pos").cast("string"),
        F.lit(": Clip "),
        (F.col("l_partkey") % n + 1).cast("string"),
        F.lit(", Clip "),
        (F.col("l_suppkey") % (n + 2) + 1).cast("string"),
    )
    t = views.tag()
    line = F.when((t == "a") & (F.col("display_pos") == n), F.lit("(nothing more)")).otherwise(line)
    line = F.when((t == "b") & (F.col("display_pos") == 1), F.concat(F.lit(head), F.lit("1: none"))).otherwise(line)
    packed = F.sort_array(F.collect_list(F.struct("display_pos", line.alias("l"))))
    one = items.groupBy(*KEYS).agg(F.max("n_items").alias("n_lines"), packed.alias("_x"))
    body = F.array_join(F.transform("_x", lambda x: x["l"]), "\n")
    raw = F.when(t == "d", "").when(t == "e", F.lower(body)).otherwise(body)
    return one.select(*KEYS, "n_lines", F.col("n_lines").alias("n_ids"), raw.alias("raw_output"))


def grounding_sql(head: str = "Summary ") -> str:
    return f"""
answer_lines AS (SELECT video_id, n_items, display_pos, substr(md5(video_id), 1, 1) AS t,
  CASE WHEN substr(md5(video_id), 1, 1) = 'b' AND display_pos = 1 THEN '{head}1: none'
       WHEN substr(md5(video_id), 1, 1) = 'a' AND display_pos = n_items THEN '(nothing more)'
       ELSE '{head}' || display_pos || ': Clip ' || (l_partkey % n_items + 1) || ', Clip ' || (l_suppkey % (n_items + 2) + 1) END AS l FROM task_items),
grounding AS (SELECT video_id, any_value(n_items) AS n, CASE any_value(t) WHEN 'd' THEN '' WHEN 'e' THEN lower(string_agg(l, chr(10) ORDER BY display_pos))
  ELSE string_agg(l, chr(10) ORDER BY display_pos) END AS raw FROM answer_lines GROUP BY video_id),
slots AS (SELECT video_id, n, raw, unnest(range(1, n + 1)) AS k FROM grounding),
parts AS (SELECT video_id, n, k, regexp_matches(raw, '(?is){head}' || k || '\\s*:\\s*.') AS present,
  regexp_split_to_array(regexp_extract(raw, '(?is){head}' || k || '\\s*:\\s*(.*)', 1), '(?i){head}\\d')[1] AS part FROM slots),
parsed AS (SELECT video_id, n, k, present, list_filter(list_transform(regexp_extract_all(part, '\\d+'), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 1 AND n) AS ids FROM parts)
"""


REPORT = """
SELECT video_id, CAST(bool_and(present) AS INT) AS format_ok, count(*) FILTER (WHERE len(ids) > 0) AS nonempty_count,
  coalesce(string_agg(CASE WHEN NOT present THEN 'missing_line_' || k WHEN len(ids) = 0 THEN 'no_valid_clip_ids_line_' || k END, ';' ORDER BY k), '') AS reasons,
  string_agg(array_to_string(list_transform(ids, lambda x: x - 1), ','), '|' ORDER BY k) AS ids
FROM parsed GROUP BY video_id
"""


def report(parsed):
    said = F.array_join(
        F.transform("lines", lambda x: F.array_join(F.transform(x["ids"], lambda i: i.cast("string")), ",")), "|"
    )
    return parsed.select(
        "video_id",
        F.col("format_ok").cast("int").alias("format_ok"),
        "nonempty_count",
        F.array_join("failure_reasons", ";").alias("reasons"),
        said.alias("ids"),
    )


@query("parse_assignments", with_ctes(ORDER_LINES, TASK_ITEMS, grounding_sql(), body=REPORT))
def parse_assignments(spark, sf):
    return report(ps.parse_assignments(grounding_answers(spark, sf)))


@query(
    "parse_assignments_strict",
    with_ctes(
        ORDER_LINES,
        TASK_ITEMS,
        grounding_sql(),
        body="""SELECT video_id, CAST(bool_and(present AND len(ids) > 0) AS INT) AS format_ok, count(*) FILTER (WHERE len(ids) > 0) AS nonempty_count,
        coalesce(string_agg(CASE WHEN NOT present THEN 'missing Summary ' || k END, ';' ORDER BY k), '') AS reasons,
        string_agg(array_to_string(list_transform(ids, lambda x: x - 1), ','), '|' ORDER BY k) AS ids FROM parsed GROUP BY video_id""",
    ),
)
def parse_assignments_strict(spark, sf):
    return report(ps.parse_assignments(grounding_answers(spark, sf), strict=True))


@query("parse_candidates", with_ctes(ORDER_LINES, TASK_ITEMS, grounding_sql("Candidate Doc "), body=REPORT))
def parse_candidates(spark, sf):
    return report(ps.parse_candidates(grounding_answers(spark, sf, "Candidate Doc ")))


def index_answers(spark, sf):
    """Bracketed lists, prose, repeats, broken lists; every second item at least is asked for."""
    a = views.ranking_answers(spark, sf)
    ids = F.regexp_replace(F.regexp_replace("raw_output", r"(?i)<think>.*</think>|shot ", ""), " > ", ", ")
    t = F.substring(F.md5("video_id"), 2, 1)
    raw = (
        F.when(t == "a", F.concat(F.lit("Frames "), F.regexp_replace(ids, ", ", " and ")))
        .when(t == "b", F.concat(F.lit("["), F.regexp_replace(ids, ", ", " "), F.lit("] or 1")))
        .when(t == "c", F.concat(F.lit("["), ids, F.lit(", 99, 1]")))
        .when(t == "d", F.lit("none of them"))
        .otherwise(F.concat(F.lit("Answer: ["), ids, F.lit("] because [7]")))
    )
    return a.select(*KEYS, "n_items", F.ceil(F.col("n_items") / 2).cast("long").alias("n_select"), raw.alias("raw_output"))


INDEX_ANSWERS = """
plain AS (SELECT video_id, n_items, CAST(ceil(n_items / 2) AS BIGINT) AS n_select, substr(md5(video_id), 2, 1) AS t,
  replace(regexp_replace(raw_output, '(?i)<think>.*</think>|shot ', '', 'g'), ' > ', ', ') AS ids FROM ranking_answers),
index_answers AS (SELECT *, CASE t WHEN 'a' THEN 'Frames ' || replace(ids, ', ', ' and ') WHEN 'b' THEN '[' || replace(ids, ', ', ' ') || '] or 1'
  WHEN 'c' THEN '[' || ids || ', 99, 1]' WHEN 'd' THEN 'none of them' ELSE 'Answer: [' || ids || '] because [7]' END AS raw FROM plain),
picked AS (SELECT video_id, n_items, n_select, CASE WHEN regexp_matches(regexp_extract(raw, '\\[[\\d,\\s]+\\]'), '^\\[\\d+(, \\d+)*\\]$')
  THEN regexp_extract_all(regexp_extract(raw, '\\[[\\d,\\s]+\\]'), '\\d+') ELSE regexp_extract_all(raw, '\\b\\d+\\b') END AS said FROM index_answers),
kept AS (SELECT video_id, n_select, x, row_number() OVER (PARTITION BY video_id ORDER BY p) AS r FROM
  (SELECT video_id, n_items, n_select, CAST(x AS BIGINT) AS x, min(p) AS p FROM (SELECT video_id, n_items, n_select, unnest(said) AS x, generate_subscripts(said, 1) AS p FROM picked)
   WHERE CAST(x AS BIGINT) BETWEEN 1 AND n_items GROUP BY ALL))
"""


@query(
    "parse_index_list",
    with_ctes(
        *ORDER_CTES,
        INDEX_ANSWERS,
        body="""SELECT p.video_id, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= k.n_select), '') AS selected,
        CASE WHEN count(x) > 0 THEN 1 ELSE 0 END AS parse_ok FROM picked p LEFT JOIN kept k USING (video_id) GROUP BY p.video_id""",
    ),
)
def parse_index_list(spark, sf):
    out = ps.parse_index_list(index_answers(spark, sf))
    return out.select("video_id", joined("selected").alias("selected"), F.col("parse_ok").cast("int").alias("parse_ok"))


@query(
    "parse_first_index",
    with_ctes(
        *ORDER_CTES,
        INDEX_ANSWERS,
        """firsts AS (SELECT video_id, n_items, TRY_CAST(nullif(regexp_extract(raw, '\\b(\\d+)\\b', 1), '') AS BIGINT) AS x FROM index_answers)""",
        body="""SELECT video_id, CASE WHEN x BETWEEN 1 AND n_items THEN x - 1 ELSE n_items // 2 END AS idx,
        CASE WHEN x BETWEEN 1 AND n_items THEN 1 ELSE 0 END AS ok FROM firsts""",
    ),
)
def parse_first_index(spark, sf):
    idx, ok = ps.parse_first_index(F.col("raw_output"), F.col("n_items"))
    return index_answers(spark, sf).select("video_id", idx.alias("idx"), ok.cast("int").alias("ok"))


def summary_answers(spark, sf):
    """Whole documents as the summary part of an answer, with a frame list behind."""
    d = views.documents(spark, sf)
    k = F.col("doc_id")
    numbered = F.concat(F.lit("1. "), F.regexp_replace("text", "\n", "\n- "))
    body = F.when(k % 3 == 0, numbered).otherwise(F.col("text"))
    head = F.when(k % 7 == 6, F.lit("Here it is: ")).otherwise(F.lit("TASK 1\nSummary : \n"))
    a, b = (k % 9).cast("string"), (k % 40).cast("string")
    frames = F.when(k % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("\n\nIMPORTANT FRAMES: [Frame "), a, F.lit(", Frame "), b, F.lit(", "), a, F.lit("]"))
    )
    return d.select(
        F.lit("documents").alias("dataset"),
        k.cast("string").alias("video_id"),
        F.concat(head, body, frames).alias("raw_output"),
        (k % 4 + 1).alias("n_sentences"),
        F.lit(20).alias("n_frames"),
        F.lit(2).alias("n_select"),
    )


SUMMARY_ANSWERS = """
summary_answers AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS video_id, doc_id % 4 + 1 AS n,
  CASE WHEN doc_id % 7 = 6 THEN 'Here it is: ' ELSE 'TASK 1' || chr(10) || 'Summary : ' || chr(10) END
  || CASE WHEN doc_id % 3 = 0 THEN '1. ' || replace(text, chr(10), chr(10) || '- ') ELSE text END
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || chr(10) || 'IMPORTANT FRAMES: [Frame ' || (doc_id % 9) || ', Frame ' || (doc_id % 40) || ', ' || (doc_id % 9) || ']' END AS raw
  FROM documents)
"""

STRIP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{STRIP}+', ''), '{STRIP}+$', '')"


def two_level_sql(block: str) -> str:
    """Lines, bullets and sentence boundaries by marking and splitting."""
    return f"""
blocks AS (SELECT video_id, n, {block} AS block FROM summary_answers),
cleaned AS (SELECT video_id, n, block IS NOT NULL AS found, coalesce(list_filter(list_transform(list_filter(list_transform(string_split(block, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> ''),
  lambda x: regexp_replace(regexp_replace(x, '^\\d+[.)]{STRIP}*', CASE WHEN regexp_matches(x, '^\\d+[.)]') THEN chr(1) ELSE '' END), CASE WHEN regexp_matches(x, '^[-*•]') THEN '^[-*•]{STRIP}*' ELSE chr(1) END, '')), lambda x: x <> ''), []) AS c FROM blocks),
marked AS (SELECT *, list_filter(list_transform(string_split(regexp_replace({trimmed("array_to_string(c, ' ')")}, '([.!?]){STRIP}+', '\\1' || chr(2), 'g'), chr(2)), lambda x: {trimmed('x')}), lambda x: x <> '') AS s FROM cleaned),
decided AS (SELECT *, CASE WHEN len(c) >= n THEN c[1:n] WHEN len(c) > 0 AND len(s) >= len(c) THEN s ELSE c END AS got,
  CASE WHEN len(c) >= n THEN 'line' WHEN len(c) > 0 THEN 'sentence_fallback' END AS parse_mode FROM marked)
"""


@query(
    "parse_summary",
    with_ctes(
        SUMMARY_ANSWERS,
        two_level_sql(
            r"CASE WHEN regexp_matches(raw, '(?is)SUMMARY\s*:') THEN regexp_extract(raw, '(?is)SUMMARY\s*:\s*\n?(.*)', 1) END"
        ),
        body="""SELECT video_id, len(got) AS n_got, md5(array_to_string(got, '|')) AS sentences, parse_mode,
        CASE WHEN NOT found THEN 'no_summary_section' WHEN len(got) = 0 THEN 'empty_summary_block; no_sentences_extracted'
             WHEN len(got) <> n THEN 'sentence_count_mismatch(got=' || len(got) || ',expected=' || n || ')' END AS failure_reason FROM decided""",
    ),
)
def parse_summary(spark, sf):
    out = ps.parse_summary(summary_answers(spark, sf))
    return out.select(
        "video_id",
        F.size("sentences").cast("long").alias("n_got"),
        F.md5(F.array_join("sentences", "|")).alias("sentences"),
        "parse_mode",
        "failure_reason",
    )


@query(
    "parse_summary_and_frames",
    with_ctes(
        SUMMARY_ANSWERS,
        two_level_sql(
            r"CASE WHEN regexp_matches(raw, '(?is)SUMMARY\s*:\s*\n') THEN regexp_split_to_array(regexp_extract(raw, '(?is)SUMMARY\s*:\s*\n(.*)', 1), '(?i)TASK\s*2|IMPORTANT\s*FRAMES')[1] END"
        ),
        r"""frame_ids AS (SELECT video_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 9 = doc_id % 40 THEN [doc_id % 9] ELSE [doc_id % 9, doc_id % 40] END AS ids FROM summary_answers)""",
        """sel AS (SELECT video_id, doc_id, list_filter(ids, lambda x: x BETWEEN 1 AND 20) AS ids FROM frame_ids)""",
        body="""SELECT d.video_id, md5(array_to_string(got, '|')) AS sentences, array_to_string(ids, ',') AS selected, CASE WHEN len(ids) > 0 THEN 1 ELSE 0 END AS parse_ok,
        nullif(concat_ws('; ', CASE WHEN NOT found THEN 'no_summary_section' END, CASE WHEN doc_id % 5 = 0 THEN 'no_frames_section' WHEN len(ids) = 0 THEN 'no_valid_frame_numbers'
        WHEN len(ids) <> 2 THEN 'frames_count_mismatch(got=' || len(ids) || ',expected=2)' END), '') AS failure_reason FROM decided d JOIN sel USING (video_id)""",
    ),
)
def parse_summary_and_frames(spark, sf):
    out = ps.parse_summary_and_frames(summary_answers(spark, sf))
    return out.select(
        "video_id",
        F.md5(F.array_join("sentences", "|")).alias("sentences"),
        joined("selected").alias("selected"),
        F.col("parse_ok").cast("int").alias("parse_ok"),
        "failure_reason",
    )


@query(
    "parse_summary_with_frames",
    with_ctes(
        SUMMARY_ANSWERS,
        rf"""blocks AS (SELECT video_id, doc_id, {trimmed(r"regexp_split_to_array(regexp_extract(raw, '(?is)SUMMARY\s*:[ \t]*\n?(.*)', 1), '(?i)IMPORTANT FRAMES')[1]")} AS block FROM summary_answers)""",
        rf"""ln AS (SELECT video_id, doc_id, list_filter(list_transform(string_split(block, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '') AS l FROM blocks)""",
        rf"""num AS (SELECT *, list_transform(list_filter(l, lambda x: regexp_matches(x, '^\d+\..')), lambda x: regexp_replace(x, '^\d+\.{STRIP}*', '')) AS k FROM ln)""",
        body="""SELECT video_id, md5(array_to_string(CASE WHEN len(k) > 0 THEN k ELSE l END, '|')) AS sentences,
        CASE WHEN len(l) > 0 AND doc_id % 5 <> 0 AND (doc_id % 9 > 0 OR doc_id % 40 BETWEEN 1 AND 20) THEN 1 ELSE 0 END AS parse_ok FROM num""",
    ),
)
def parse_summary_with_frames(spark, sf):
    out = ps.parse_summary_with_frames(summary_answers(spark, sf))
    return out.select(
        "video_id", F.md5(F.array_join("sentences", "|")).alias("sentences"), F.col("parse_ok").cast("int").alias("parse_ok")
    )


THIRDS = """
thirds AS (SELECT doc_id, 'First Third: ' || text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'MIDDLE THIRD : ' || source || chr(10) END
  || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'LAST THIRD:' || chr(10) || lang || ' ' END AS raw FROM documents)
"""


@query(
    "parse_thirds",
    with_ctes(
        THIRDS,
        body=rf"""SELECT doc_id, md5({trimmed(r"regexp_split_to_array(regexp_extract(raw, '(?is)FIRST THIRD\s*:\s*(.*)', 1), '(?i)MIDDLE THIRD|LAST THIRD')[1]")}) AS first_third,
        {trimmed(r"regexp_split_to_array(regexp_extract(raw, '(?is)MIDDLE THIRD\s*:\s*(.*)', 1), '(?i)LAST THIRD')[1]")} AS middle_third,
        {trimmed(r"regexp_extract(raw, '(?is)LAST THIRD\s*:\s*(.+)', 1)")} AS last_third FROM thirds""",
    ),
)
def parse_thirds(spark, sf):
    k = F.col("doc_id")
    raw = F.concat(
        F.lit("First Third: "),
        "text",
        F.lit("\n"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("MIDDLE THIRD : "), "source", F.lit("\n"))),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("LAST THIRD:\n"), "lang", F.lit(" "))),
    )
    d = views.documents(spark, sf).select("doc_id", raw.alias("raw")).withColumns(ps.parse_thirds(F.col("raw")))
    return d.select("doc_id", F.md5("first_third").alias("first_third"), "middle_third", "last_third")


GENERATED = """
generated AS (SELECT doc_id, '[Shots ' || (doc_id % 5) || '-' || (doc_id % 5 + doc_id % 3) || '] ' || replace(text, chr(10), ' ') || ' (Note: made up' || chr(10) || 'twice)' || chr(10) || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'Note: the rest follows' || chr(10) || chr(10) ELSE 'Untagged line.' || chr(10) || chr(10) END
  || '[shot 7] ' || source || chr(10) || ' Note: dropped' || chr(10) || chr(10) || '[Shot 8] is missing' AS document FROM documents)
"""


def generated(spark, sf):
    k = F.col("doc_id")
    parts = [
        F.lit("[Shots "),
        (k % 5).cast("string"),
        F.lit("-"),
        (k % 5 + k % 3).cast("string"),
        F.lit("] "),
        F.regexp_replace("text", "\n", " "),
        F.lit(" (Note: made up\ntwice)\n\n"),
        F.when(k % 2 == 0, "Note: the rest follows\n\n").otherwise("Untagged line.\n\n"),
        F.lit("[shot 7] "),
        F.col("source"),
        F.lit("\n Note: dropped\n\n[Shot 8] is missing"),
    ]
    return views.documents(spark, sf).select("doc_id", F.concat(*parts).alias("document"))


@query(
    "parse_aligned_document",
    with_ctes(
        GENERATED,
        f"""paras AS (SELECT doc_id, list_filter(list_transform(string_split(document, chr(10) || chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '') AS p FROM generated)""",
        """flat AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS sentence_id FROM paras)""",
        body=rf"""SELECT doc_id, sentence_id, CASE WHEN regexp_matches(p, '(?i)^\[Shots?\s+\d+(-\d+)?\]') THEN md5({trimmed(r"regexp_replace(p, '(?i)^\[Shots?\s+\d+(-\d+)?\]', '')")}) ELSE md5(p) END AS text,
        CASE WHEN regexp_matches(p, '(?i)^\[Shots?\s+\d+(-\d+)?\]') THEN array_to_string(range(CAST(regexp_extract(p, '(?i)^\[Shots?\s+(\d+)', 1) AS BIGINT),
        1 + CAST(coalesce(nullif(regexp_extract(p, '(?i)^\[Shots?\s+\d+-(\d+)', 1), ''), regexp_extract(p, '(?i)^\[Shots?\s+(\d+)', 1)) AS BIGINT)), ',') ELSE '' END AS shot_ids FROM flat""",
    ),
)
def parse_aligned_document(spark, sf):
    out = ps.parse_aligned_document(generated(spark, sf))
    return out.select("doc_id", "sentence_id", F.md5("text").alias("text"), joined("shot_ids").alias("shot_ids"))


@query(
    "clean_generated_text",
    with_ctes(
        GENERATED,
        body=f"""SELECT doc_id, md5('[Shots ' || (doc_id % 5) || '-' || (doc_id % 5 + doc_id % 3) || '] ' || {trimmed("replace(text, chr(10), ' ')")} || chr(10) || chr(10) || '[shot 7] ' || source) AS cleaned
        FROM generated JOIN documents USING (doc_id)""",
    ),
)
def clean_generated_text(spark, sf):
    out = generated(spark, sf)
    return out.select("doc_id", F.md5(ps.clean_generated_text(F.col("document"))).alias("cleaned"))


@query(
    "strip_thinking",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '' ELSE md5({trimmed('text')}) END AS answer FROM documents""",
)
def strip_thinking(spark, sf):
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("<THINK>"), "source", F.lit("\n</think> "), "text"))
        .when(k == 1, F.concat(F.lit(" \n<think> "), "text"))
        .when(k == 2, F.concat(F.col("text"), F.lit("<think>c\n\nd</think> \n")))
        .when(k == 3, F.concat(F.lit("<think>a</think>"), "text", F.lit(" <think>b</think>")))
    )
    out = text.strip_thinking(raw)
    return views.documents(spark, sf).select(
        "doc_id", F.when(k == 1, out).otherwise(F.md5(out)).alias("answer")
    )


@query(
    "split_sentences",
    f"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS sentences FROM (SELECT doc_id,
    list_filter(list_transform(string_split(regexp_replace({trimmed('text')}, '([.!?]){STRIP}+', '\\1' || chr(2), 'g'), chr(2)), lambda x: {trimmed('x')}), lambda x: x <> '') AS s FROM documents)""",
)
def split_sentences(spark, sf):
    s = text.split_sentences(F.col("text"))
    return views.documents(spark, sf).select(
        "doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("sentences")
    )


SOFT = "The {} saw {} there; {} stayed."
SOFT_WORDS = ["Child", "blood", "killing", "kid's", "self harm", "murdered", "skill", "bloody", "naked", "topless"]


def soft_sql() -> str:
    from spanforge.functions.text import SOFTER_WORDS

    words = ", ".join("'" + w.replace("'", "''") + "'" for w in SOFT_WORDS)
    out = f"""text || ' The ' || ([{words}])[doc_id % 10 + 1] || ' saw ' || ([{words}])[(doc_id * 3) % 10 + 1]"""
    for pattern, softer in SOFTER_WORDS:
        out = f"regexp_replace({out}, '(?i){pattern}', '{softer}', 'g')"
    return out


@query("soften_text", f"SELECT doc_id, md5({soft_sql()}) AS softened FROM documents")
def soften_text(spark, sf):
    words = F.array(*[F.lit(w) for w in SOFT_WORDS])
    pick = lambda m: F.get(words, (F.col("doc_id") * m % 10).cast("int"))
    raw = F.concat("text", F.lit(" The "), pick(1), F.lit(" saw "), pick(3))
    return views.documents(spark, sf).select("doc_id", F.md5(text.soften_text(raw)).alias("softened"))


@query(
    "is_content_filtered",
    """SELECT page_id, CAST(coalesce(contains(lower(error), 'content_filter') OR contains(lower(error), 'responsibleaipolicyviolation'), false) AS INT) AS filtered
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || ': Content_Filter hit' WHEN 1 THEN 'ResponsibleAIPolicyViolation ' || url
      WHEN 2 THEN 'timeout ' || url END AS error FROM pages)""",
)
def is_content_filtered(spark, sf):
    k = F.col("page_id") % 4
    error = (
        F.when(k == 0, F.concat("url", F.lit(": Content_Filter hit")))
        .when(k == 1, F.concat(F.lit("ResponsibleAIPolicyViolation "), "url"))
        .when(k == 2, F.concat(F.lit("timeout "), "url"))
    )
    flag = text.is_content_filtered(error).cast("int").alias("filtered")
    return views.table(spark, sf, "pages").select("page_id", flag)


@query(
    "after_marker",
    f"SELECT doc_id, md5({trimmed('text')}) AS answer FROM documents",
)
def after_marker(spark, sf):
    raw = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("USER: a ASSISTANT: b\nASSISTANT: "), "text")
    ).otherwise(F.col("text"))
    return views.documents(spark, sf).select("doc_id", F.md5(text.after_marker(raw)).alias("answer"))
