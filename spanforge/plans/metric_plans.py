"""Metrics, run summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import aggregates as ag
from spanforge.operators import groundtruth as gt
from spanforge.operators import joins
from spanforge.operators import metrics as mt
from spanforge.operators import parsing as ps
from spanforge.operators import sampling
from spanforge.operators.ordered import KEYS, Oversize
from spanforge.plans.registry import R6, query, r6, with_ctes
from spanforge.plans.stats_plans import GTFRAMES, labelled_frames, rounded
from spanforge.plans.text_plans import (
    ORDER_CTES,
    PAIR_ANSWERS,
    RANK_IDS,
    grounding_answers,
    grounding_sql,
    pair_answers,
)
from spanforge.session import checkpoint
from spanforge.sources import views
from spanforge.sources.views import FEATURE_FRAMES, FRAMES, ORDER_LINES, SENTENCES, TASK_ITEMS

# ---- sets ------------------------------------------------------------------

TRUTH = """
truth AS (SELECT DISTINCT video_id, display_pos, x AS pred_id FROM (SELECT video_id, display_pos, unnest([l_partkey % n_items, l_linenumber % n_items]) AS x FROM task_items)),
predicted AS (SELECT DISTINCT video_id, k AS display_pos, unnest(ids) - 1 AS pred_id FROM parsed),
overlap AS (SELECT u.video_id, u.display_pos, count(p.pred_id) AS n_pred, count(t.pred_id) AS n_gt, count(*) FILTER (WHERE p.pred_id = t.pred_id) AS n_inter,
  count(coalesce(p.pred_id, t.pred_id)) AS n_union
  FROM task_items u LEFT JOIN (SELECT coalesce(p.video_id, t.video_id) AS v, coalesce(p.display_pos, t.display_pos) AS d, p.pred_id AS pp, t.pred_id AS tt
    FROM predicted p FULL JOIN truth t ON p.video_id = t.video_id AND p.display_pos = t.display_pos AND p.pred_id = t.pred_id) f
  ON f.v = u.video_id AND f.d = u.display_pos
  LEFT JOIN (SELECT 1) one ON true LEFT JOIN LATERAL (SELECT f.pp AS pred_id) p ON true LEFT JOIN LATERAL (SELECT f.tt AS pred_id) t ON true
  GROUP BY u.video_id, u.display_pos),
scored AS (SELECT *, CASE WHEN n_pred > 0 THEN n_inter / n_pred ELSE 0 END AS p, CASE WHEN n_gt > 0 THEN n_inter / n_gt ELSE 0 END AS r,
  CASE WHEN n_union > 0 THEN n_inter / n_union ELSE 1 END AS iou, CASE WHEN n_inter > 0 THEN 1 ELSE 0 END AS hit FROM overlap)
"""

F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def alignment(spark, sf):
    """(units, predicted, true) ids per order line of the grounding answers; the items are drawn once."""
    items = checkpoint(views.task_items(spark, sf).select(*KEYS, "display_pos", "n_items", "l_partkey", "l_linenumber", "l_suppkey"))
    n = F.col("n_items")
    truth = items.select(
        *KEYS, "display_pos", F.explode(F.array(F.col("l_partkey") % n, F.col("l_linenumber") % n)).alias("pred_id")
    )
    pred = ps.assignment_rows(ps.parse_assignments(grounding_answers(spark, sf, items=items)))
    return items.select(*KEYS, "display_pos"), pred, truth


@query(
    "set_overlap",
    with_ctes(
        ORDER_LINES,
        TASK_ITEMS,
        grounding_sql(),
        TRUTH,
        body="SELECT video_id, display_pos, n_pred, n_gt, n_inter, n_union FROM overlap",
    ),
)
def set_overlap(spark, sf):
    return mt.set_overlap(*alignment(spark, sf), [*KEYS, "display_pos"], "pred_id").drop("dataset")


@query(
    "set_metrics",
    with_ctes(
        ORDER_LINES,
        TASK_ITEMS,
        grounding_sql(),
        TRUTH,
        body=f"""SELECT video_id, display_pos, n_pred, n_gt, n_inter, n_union, {R6("p")} AS p, {R6("r")} AS r, {R6(F1)} AS f1, {R6("iou")} AS iou, hit FROM scored""",
    ),
)
def set_metrics(spark, sf):
    return rounded(mt.set_metrics(*alignment(spark, sf), [*KEYS, "display_pos"], "pred_id").drop("dataset"))


@query(
    "set_f1",
    with_ctes(
        FRAMES,
        GTFRAMES,
        """k AS (SELECT video_id, count(*) AS n_gt FROM gt_frames WHERE gtframe = 1 GROUP BY video_id)""",
        """q AS (SELECT video_id, count(*) FILTER (WHERE gtscore > 80) AS n_pred, count(*) FILTER (WHERE gtscore > 80 AND gtframe = 1) AS i FROM gt_frames GROUP BY video_id)""",
        """s AS (SELECT video_id, CASE WHEN n_pred > 0 THEN i / n_pred ELSE 0 END AS p, i / n_gt AS r FROM q JOIN k USING (video_id))""",
        body=f"""SELECT video_id, {R6("p")} AS "precision", {R6("r")} AS recall, {R6(F1)} AS f1 FROM s""",
    ),
)
def set_f1(spark, sf):
    f = labelled_frames(spark, sf)
    units = f.select(*KEYS).distinct()
    out = mt.set_f1(units, f.filter("gtscore > 80"), f.filter("gtframe = 1"), list(KEYS), "step")
    return rounded(out.drop("dataset"))


@query(
    "macro_avg",
    with_ctes(
        ORDER_LINES,
        TASK_ITEMS,
        grounding_sql(),
        TRUTH,
        f"""per AS (SELECT video_id, avg(p) AS p, avg(r) AS r, avg({F1}) AS f1, avg(iou) AS iou, avg(hit) AS hit FROM scored GROUP BY video_id)""",
        body=f"""SELECT 'orders' AS dataset, {R6("avg(p)")} AS p, {R6("avg(r)")} AS r, {R6("avg(f1)")} AS f1, {R6("avg(iou)")} AS iou, {R6("avg(hit)")} AS hit FROM per""",
    ),
)
def macro_avg(spark, sf):
    units = mt.set_metrics(*alignment(spark, sf), [*KEYS, "display_pos"], "pred_id")
    return rounded(ag.macro_avg(units, ["p", "r", "f1", "iou", "hit"], ["dataset"]))


# ---- rankings --------------------------------------------------------------

def with_scores(spark, sf):
    """Parsed rankings beside the true scores by display label."""
    return ps.parse_ranking_reasoned(views.ranking_answers(spark, sf, F.col("score")))


RANKED = """
said_pos AS (SELECT video_id, CAST(unnest(said) AS BIGINT) AS display_pos, generate_subscripts(said, 1) AS pos FROM judged WHERE failure_reason IS NULL),
scored AS (SELECT t.video_id, t.score, t.n_items, -s.pos AS pred, s.pos, t.display_pos FROM task_items t JOIN said_pos s USING (video_id, display_pos))
"""

CORRELATE = """
ranks AS (SELECT *, rank() OVER (PARTITION BY video_id ORDER BY pred) + (count(*) OVER (PARTITION BY video_id, pred) - 1) / 2 AS rp,
  rank() OVER (PARTITION BY video_id ORDER BY score) + (count(*) OVER (PARTITION BY video_id, score) - 1) / 2 AS rg,
  row_number() OVER (PARTITION BY video_id ORDER BY score DESC, display_pos) AS gpos FROM scored),
rho AS (SELECT video_id, CASE WHEN count(*) > 1 AND var_pop(rp) > 0 AND var_pop(rg) > 0 THEN corr(rp, rg) END AS rho,
  least(3, max(n_items)) AS top_k, count(*) FILTER (WHERE pos <= least(3, n_items) AND gpos <= least(3, n_items)) / least(3, max(n_items)) AS topp FROM ranks GROUP BY video_id),
tau AS (SELECT a.video_id, sum(sign(a.pred - b.pred) * sign(a.score - b.score)) AS s, sum(abs(sign(a.pred - b.pred))) AS x, sum(abs(sign(a.score - b.score))) AS y
  FROM scored a JOIN scored b ON a.video_id = b.video_id GROUP BY a.video_id)
"""


@query(
    "ranking_metrics",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        RANKED,
        CORRELATE,
        body=f"""SELECT i.video_id, {R6("rho")} AS spearman_r, {R6("CASE WHEN x > 0 AND y > 0 THEN s / sqrt(x * y) END")} AS kendall_tau, top_k, {R6("topp")} AS top_k_precision
        FROM ids i LEFT JOIN rho USING (video_id) LEFT JOIN tau USING (video_id)""",
    ),
)
def ranking_metrics(spark, sf):
    out = mt.ranking_metrics(with_scores(spark, sf))
    return rounded(out.select("video_id", "spearman_r", "kendall_tau", "top_k", "top_k_precision"))


@query(
    "temporal_ranking_metrics",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        """said_pos AS (SELECT video_id, CAST(unnest(said) AS BIGINT) AS display_pos, generate_subscripts(said, 1) AS pos FROM judged WHERE failure_reason IS NULL)""",
        """scored AS (SELECT t.video_id, max(t.orig_pos) OVER (PARTITION BY t.video_id) - t.orig_pos AS score, t.n_items, -s.pos AS pred, s.pos, t.display_pos
             FROM task_items t JOIN said_pos s USING (video_id, display_pos))""",
        CORRELATE,
        body=f"""SELECT video_id, {R6("rho")} AS spearman_r, {R6("CASE WHEN x > 0 AND y > 0 THEN s / sqrt(x * y) END")} AS kendall_tau, {R6("topp")} AS top_k_precision
        FROM rho JOIN tau USING (video_id)""",
    ),
)
def temporal_ranking_metrics(spark, sf):
    # Sampled positions are dense, so the last one is known in the row.
    score = (F.col("n_items") - 1 - F.col("orig_pos")).cast("double")
    parsed = ps.parse_ranking_reasoned(views.ranking_answers(spark, sf, score))
    # Spark would test a filter on the raw answers and parse them again; a list of none or one ranking is no filter.
    fine = F.when(F.col("failure_reason").isNull(), F.array("ranking"))
    out = mt.ranking_metrics(parsed.select(*KEYS, "scores", F.explode(fine).alias("ranking")))
    return rounded(out.select("video_id", "spearman_r", "kendall_tau", "top_k_precision"))


@query(
    "temporal_gt_scores",
    with_ctes(
        ORDER_LINES,
        TASK_ITEMS,
        body="SELECT video_id, item_key, CAST(max(orig_pos) OVER (PARTITION BY video_id) - orig_pos AS DOUBLE) AS gt_score FROM task_items",
    ),
)
def temporal_gt_scores(spark, sf):
    return mt.temporal_gt_scores(views.task_items(spark, sf)).select("video_id", "item_key", "gt_score")


@query(
    "selection_rank_corr",
    with_ctes(
        FRAMES,
        """x AS (SELECT video_id, round(gtscore / 10) AS score, CASE WHEN step % 7 = 0 OR gtscore > 150 THEN 1 ELSE 0 END AS selected FROM frames)""",
        """ranks AS (SELECT *, rank() OVER (PARTITION BY video_id ORDER BY score) + (count(*) OVER (PARTITION BY video_id, score) - 1) / 2 AS rg,
             rank() OVER (PARTITION BY video_id ORDER BY selected) + (count(*) OVER (PARTITION BY video_id, selected) - 1) / 2 AS rp FROM x)""",
        """rho AS (SELECT video_id, corr(rp, rg) AS rho FROM ranks GROUP BY video_id)""",
        """tau AS (SELECT a.video_id, sum(sign(a.selected - b.selected) * sign(a.score - b.score)) AS s, sum(abs(sign(a.selected - b.selected)))::DOUBLE AS x,
             sum(abs(sign(a.score - b.score)))::DOUBLE AS y FROM x a JOIN x b ON a.video_id = b.video_id GROUP BY a.video_id)""",
        body=f"SELECT video_id, {R6('rho')} AS spearman_rho, {R6('s / sqrt(x * y)')} AS kendall_tau FROM rho JOIN tau USING (video_id)",
    ),
)
def selection_rank_corr(spark, sf):
    picked = (F.col("step") % 7 == 0) | (F.col("gtscore") > 150)
    items = views.frames(spark, sf).select(
        *KEYS, F.round(F.col("gtscore") / 10).alias("score"), picked.cast("int").alias("selected")
    )
    return rounded(mt.selection_rank_corr(items).drop("dataset"))


WINS = """
wins AS (SELECT t.video_id, t.orig_pos, t.n_items, count(w.video_id) AS wins FROM task_items t LEFT JOIN winners w ON w.video_id = t.video_id
  AND ((w.winner = 'A' AND w.i = t.orig_pos) OR (w.winner = 'B' AND w.j = t.orig_pos)) GROUP BY ALL)
"""


def wins(spark, sf):
    pairs = pair_answers(spark, sf).withColumn("winner", ps.parse_winner(F.col("raw_output")))
    return ag.win_counts(pairs, views.task_items(spark, sf))


@query("win_counts", with_ctes(ORDER_LINES, TASK_ITEMS, PAIR_ANSWERS, WINS, body="SELECT video_id, orig_pos, wins FROM wins"))
def win_counts(spark, sf):
    return wins(spark, sf).drop("dataset")


@query(
    "rank_from_wins",
    with_ctes(
        ORDER_LINES,
        TASK_ITEMS,
        PAIR_ANSWERS,
        WINS,
        body="""SELECT video_id, orig_pos, row_number() OVER (PARTITION BY video_id ORDER BY wins DESC, orig_pos) AS "rank" FROM wins""",
    ),
)
def rank_from_wins(spark, sf):
    # Sampled groups hold a handful of items, so none needs to be counted first, which would judge all pairs twice.
    return mt.rank_from_wins(wins(spark, sf), Oversize()).select("video_id", "orig_pos", "rank")


# ---- chains ----------------------------------------------------------------

PREDICTED_DOCS = """
n_docs AS (SELECT video_id, count(*) AS n FROM sentences WHERE block = 'document' GROUP BY video_id),
sd AS (SELECT DISTINCT s.video_id, s.sentence_id, unnest([(s.sentence_id + length(s.text)) % n, s.sentence_id]) AS doc_id FROM sentences s JOIN n_docs USING (video_id) WHERE block = 'summary'),
dc AS (SELECT video_id, sentence_id AS doc_id, unnest([shot_ids[1], shot_ids[1] + 2]) AS clip_id FROM sentences WHERE block = 'document'),
gd AS (SELECT s.video_id, s.sentence_id, d.sentence_id AS doc_id FROM sentences s JOIN sentences d ON d.video_id = s.video_id AND d.block = 'document'
  AND list_has_any(s.shot_ids, d.shot_ids) WHERE s.block = 'summary'),
gc AS (SELECT video_id, sentence_id, unnest(shot_ids) AS id FROM sentences WHERE block = 'summary'),
fin AS (SELECT DISTINCT video_id, sentence_id, clip_id AS id FROM sd JOIN dc USING (video_id, doc_id)),
orc AS (SELECT DISTINCT video_id, sentence_id, clip_id AS id FROM gd JOIN dc USING (video_id, doc_id)),
units AS (SELECT video_id, sentence_id FROM sentences WHERE block = 'summary'),
both_sides AS (
  SELECT 'step1' AS part, video_id, sentence_id, doc_id AS id, 1 AS p, 0 AS g FROM sd UNION ALL SELECT 'step1', video_id, sentence_id, doc_id, 0, 1 FROM gd
  UNION ALL SELECT 'final', video_id, sentence_id, id, 1, 0 FROM fin UNION ALL SELECT 'final', video_id, sentence_id, id, 0, 1 FROM gc
  UNION ALL SELECT 'oracle', video_id, sentence_id, id, 1, 0 FROM orc UNION ALL SELECT 'oracle', video_id, sentence_id, id, 0, 1 FROM gc),
sizes AS (SELECT part, video_id, sentence_id, sum(p) AS np, sum(g) AS ng, count(*) FILTER (WHERE p = 1 AND g = 1) AS ni, count(*) AS nu
  FROM (SELECT part, video_id, sentence_id, id, max(p) AS p, max(g) AS g FROM both_sides GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT u.part, u.video_id, u.sentence_id, CASE WHEN np > 0 THEN ni / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN ni / ng ELSE 0 END AS r,
  CASE WHEN nu > 0 THEN ni / nu ELSE 1 END AS iou, CASE WHEN ni > 0 THEN 1 ELSE 0 END AS hit
  FROM (SELECT part, video_id, sentence_id FROM units, (VALUES ('step1'), ('final'), ('oracle')) v(part)) u LEFT JOIN sizes USING (part, video_id, sentence_id))
"""


@query(
    "chain_metrics",
    with_ctes(
        SENTENCES,
        PREDICTED_DOCS,
        f"""per AS (SELECT part, video_id, avg(p) AS p, avg(r) AS r, avg({F1}) AS f1, avg(iou) AS iou, avg(hit) AS hit FROM pr GROUP BY part, video_id)""",
        body=f"""SELECT 'talks' AS dataset, part, {R6("avg(p)")} AS p, {R6("avg(r)")} AS r, {R6("avg(f1)")} AS f1, {R6("avg(iou)")} AS iou, {R6("avg(hit)")} AS hit FROM per GROUP BY part""",
    ),
)
def chain_metrics(spark, sf):
    s = views.sentences(spark, sf)
    summaries, docs = s.filter("block = 'summary'"), s.filter("block = 'document'")
    n_docs = docs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    guess = F.explode(F.array((F.col("sentence_id") + F.length("text")) % F.col("n"), F.col("sentence_id")))
    sentence_docs = summaries.join(n_docs, list(KEYS)).select(*KEYS, "sentence_id", guess.alias("doc_id")).distinct()
    first = F.get("shot_ids", F.lit(0))
    doc_clips = docs.select(*KEYS, F.col("sentence_id").alias("doc_id"), F.explode(F.array(first, first + 2)).alias("clip_id"))
    return rounded(mt.chain_summary(mt.chain_metrics(summaries, docs, sentence_docs, doc_clips)))


# ---- text overlap ----------------------------------------------------------

def doc_pairs(spark, sf):
    """Each whole document against the reference passage assigned to it."""
    docs = views.documents(spark, sf).select("doc_id", F.col("text").alias("candidate"))
    refs = views.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("reference"))
    n_refs = refs.agg(F.max("item_id") + 1).first()[0]
    return joins.lookup_join(docs.withColumn("item_id", F.col("doc_id") % n_refs), refs, ["item_id"], small=True).select(
        "doc_id", "candidate", "reference"
    )


def turn_pairs(spark, sf):
    """Each answer in a conversation against the turn before it."""
    t = views.table(spark, sf, "conversations")
    said = t.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    asked = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return said.join(asked, ["conv_id", "turn"])


def grams_sql(key: str, pairs: str, token: str, orders: str) -> str:
    return f"""
pairs AS ({pairs}),
tok AS (SELECT {key}, 1 AS c, regexp_extract_all(lower(candidate), '{token}') AS t FROM pairs UNION ALL SELECT {key}, 0, regexp_extract_all(lower(reference), '{token}') FROM pairs),
grams AS (SELECT {key}, c, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g FROM tok, (SELECT unnest({orders}) AS n)),
cnt AS (SELECT {key}, n, g, sum(c) AS c, sum(1 - c) AS r FROM grams GROUP BY ALL),
ov AS (SELECT {key}, n, sum(least(c, r)) AS o, sum(c) AS nc, sum(r) AS nr FROM cnt GROUP BY ALL)
"""


DOC_PAIRS = "SELECT doc_id, d.text AS candidate, b.text AS reference FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)"
TURN_PAIRS = "SELECT a.conv_id, a.turn, a.text AS candidate, b.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'"


def rouge_sql(key: str, pairs: str) -> str:
    return with_ctes(
        grams_sql(key, pairs, "[a-z0-9]+", "[1, 2]"),
        f"""pr AS (SELECT {key}, n, coalesce(CASE WHEN nc > 0 THEN o / nc END, 0) AS p, coalesce(CASE WHEN nr > 0 THEN o / nr END, 0) AS r
            FROM (SELECT {key}, n FROM pairs, (SELECT unnest([1, 2]) AS n)) LEFT JOIN ov USING ({key}, n))""",
        body=f"""SELECT {key}, n, {R6("p")} AS "precision", {R6("r")} AS recall, {R6(F1)} AS f1 FROM pr""",
    )


@query("rouge_n", rouge_sql("doc_id", DOC_PAIRS))
def rouge_n(spark, sf):
    return rounded(mt.rouge_n(doc_pairs(spark, sf), ["doc_id"]))


@query("rouge_n_turns", rouge_sql("conv_id, turn", TURN_PAIRS))
def rouge_n_turns(spark, sf):
    return rounded(mt.rouge_n(turn_pairs(spark, sf), ["conv_id", "turn"]))


@query(
    "rouge_l_turns",
    with_ctes(
        f"""pairs AS ({TURN_PAIRS})""",
        """tok AS (SELECT conv_id, turn, regexp_extract_all(lower(candidate), '[a-z0-9]+') AS c, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM pairs)""",
        # One row of the table of common lengths per token of the candidate; a running maximum completes it.
        """walk AS (
          SELECT conv_id, turn, c, r, 0 AS i, list_transform(r, lambda x: 0) AS row FROM tok
          UNION ALL
          SELECT conv_id, turn, c, r, i + 1, list_transform(generate_series(1, len(r)), lambda j: list_max(list_transform(generate_series(1, j),
            lambda k: greatest(row[k], CASE WHEN r[k] = c[i + 1] THEN coalesce(row[k - 1], 0) + 1 ELSE 0 END))))
          FROM walk WHERE i < len(c))""",
        """ended AS (SELECT conv_id, turn, len(c) AS nc, len(r) AS nr, coalesce(row[len(r)], 0) AS lcs FROM walk WHERE i = len(c))""",
        """pr AS (SELECT *, CASE WHEN nc > 0 THEN lcs / nc ELSE 0 END AS p, CASE WHEN nr > 0 THEN lcs / nr ELSE 0 END AS r FROM ended)""",
        body=f"""SELECT conv_id, turn, CAST(lcs AS BIGINT) AS lcs, {R6("p")} AS "precision", {R6("r")} AS recall, {R6(F1)} AS f1 FROM pr""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def rouge_l_turns(spark, sf):
    return rounded(mt.rouge_l(turn_pairs(spark, sf), ["conv_id", "turn"]))


@query(
    "rouge_l",
    with_ctes(
        f"""pairs AS (SELECT doc_id, candidate, item_id FROM (SELECT doc_id, d.text AS candidate, b.item_id {DOC_PAIRS[DOC_PAIRS.index("FROM"):]}))""",
        """ref AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS r FROM benchmark)""",
        """posted AS (SELECT item_id, w, list(p ORDER BY p DESC) AS ps FROM (SELECT item_id, unnest(r) AS w, unnest(range(1, len(r) + 1)) AS p FROM ref) GROUP BY item_id, w)""",
        """split AS (SELECT doc_id, item_id, regexp_extract_all(lower(candidate), '[a-z0-9]+') AS c FROM pairs)""",
        """said AS (SELECT doc_id, item_id, unnest(c) AS w, unnest(range(1, len(c) + 1)) AS i FROM split)""",
        """met AS (SELECT doc_id, list(p ORDER BY i, p DESC) AS ps FROM (SELECT doc_id, i, unnest(ps) AS p FROM said JOIN posted USING (item_id, w)) GROUP BY doc_id)""",
        # Places of common words, walked through with the least last place of each length.
        """walked AS (SELECT doc_id, len(list_reduce(list_transform(ps, lambda p: [p]),
            lambda t, x: t[1:len(list_filter(t, lambda y: y < x[1]))] || x || t[len(list_filter(t, lambda y: y < x[1])) + 2:])) AS lcs FROM met)""",
        """ended AS (SELECT doc_id, coalesce(lcs, 0) AS lcs, len(c) AS nc, len(r) AS nr FROM split JOIN ref USING (item_id) LEFT JOIN walked USING (doc_id))""",
        """pr AS (SELECT *, CASE WHEN nc > 0 THEN lcs / nc ELSE 0 END AS p, CASE WHEN nr > 0 THEN lcs / nr ELSE 0 END AS r FROM ended)""",
        body=f"""SELECT doc_id, CAST(lcs AS BIGINT) AS lcs, {R6("p")} AS "precision", {R6("r")} AS recall, {R6(F1)} AS f1 FROM pr""",
    ),
)
def rouge_l(spark, sf):
    return rounded(mt.rouge_l(doc_pairs(spark, sf), ["doc_id"]))


def bleu_sql(key: str, pairs: str, eps: str) -> str:
    return with_ctes(
        grams_sql(key, pairs, "\\S+", "[1, 2, 3, 4]"),
        f"""lp AS (SELECT {key}, n, nc, nr, CASE WHEN o > 0 THEN ln(o / nc) WHEN {eps} > 0 THEN ln({eps} / nc) END AS l FROM ov WHERE nc > 0)""",
        f"""agg AS (SELECT {key}, sum(l) AS l, count(l) AS k, max(nc) FILTER (WHERE n = 1) AS c, max(nr) FILTER (WHERE n = 1) AS r FROM lp GROUP BY ALL)""",
        body=f"""SELECT {key}, {R6("coalesce(CASE WHEN k = 4 THEN (CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END) * exp(l / 4) ELSE 0 END, 0)")} AS bleu4
        FROM pairs LEFT JOIN agg USING ({key})""",
    )


@query("bleu4", bleu_sql("conv_id, turn", TURN_PAIRS, "0.0"))
def bleu4(spark, sf):
    return rounded(mt.bleu4(turn_pairs(spark, sf), ["conv_id", "turn"]))


@query("bleu4_smoothed", bleu_sql("conv_id, turn", TURN_PAIRS, "CAST(0.1 AS DOUBLE)"))
def bleu4_smoothed(spark, sf):
    return rounded(mt.bleu4(turn_pairs(spark, sf), ["conv_id", "turn"], epsilon=0.1))


@query(
    "embedding_match",
    with_ctes(
        FEATURE_FRAMES,
        """u AS (SELECT video_id, step, list_transform(feature, lambda x: CAST(x AS DOUBLE)) AS f FROM feature_frames)""",
        """v AS (SELECT video_id, step, list_transform(f, lambda x: x / sqrt(list_sum(list_transform(f, lambda y: y * y)))) AS f FROM u)""",
        body=f"""SELECT a.video_id, {R6("avg(list_sum(list_transform(list_zip(a.f, b.f), lambda p: p[1] * p[2])))")} AS score
        FROM v a JOIN v b ON a.video_id = b.video_id WHERE a.step % 3 = 0 AND b.step % 3 > 0 GROUP BY a.video_id""",
    ),
)
def embedding_match(spark, sf):
    f = views.feature_frames(spark, sf)
    out = mt.embedding_match(f.filter("step % 3 = 0"), f.filter("step % 3 > 0"))
    return rounded(out.drop("dataset"))


# ---- runs ------------------------------------------------------------------

def submitted_frames(spark, sf):
    f = gt.segment_uniform(labelled_frames(spark, sf).drop("n_steps"))
    kept = sampling.thin_uniform(f, F.lit(23).cast("long"), "step", "n_steps").select(*KEYS, "step", F.lit(1).alias("submitted"))
    out = f.join(kept, [*KEYS, "step"], "left")
    return out.withColumn("submitted", F.coalesce("submitted", F.lit(0)))


SUBMITTED = """
targets AS (SELECT video_id, n_steps, unnest(range(0, least(23, n_steps))) AS i FROM (SELECT DISTINCT video_id, n_steps FROM frames)),
sent AS (SELECT DISTINCT video_id, CASE WHEN n_steps <= 23 THEN i WHEN i = 22 THEN n_steps - 1 ELSE CAST(floor(i * (CAST(n_steps - 1 AS DOUBLE) / 22)) AS BIGINT) END AS step FROM targets),
marked AS (SELECT g.*, least(step // (n_steps // greatest(1, n_steps // 10)), greatest(1, n_steps // 10) - 1) AS shot_idx,
  CASE WHEN s.step IS NULL THEN 0 ELSE 1 END AS submitted FROM gt_frames g LEFT JOIN sent s USING (video_id, step)),
quality AS (SELECT video_id, sum(submitted) / count(*) AS coverage, sum(submitted * gtframe) / sum(gtframe) AS gt_recall,
  avg(gtscore) FILTER (WHERE submitted = 1) / avg(gtscore) AS gtscore_ratio,
  count(DISTINCT shot_idx) FILTER (WHERE submitted = 1) / count(DISTINCT shot_idx) AS shot_coverage FROM marked GROUP BY video_id)
"""
QUALITY = ["coverage", "gt_recall", "gtscore_ratio", "shot_coverage"]


@query(
    "input_quality",
    with_ctes(FRAMES, GTFRAMES, SUBMITTED, body="SELECT video_id, " + ", ".join(f"{R6(m)} AS {m}" for m in QUALITY) + " FROM quality"),
)
def input_quality(spark, sf):
    return rounded(mt.input_quality(submitted_frames(spark, sf)).drop("dataset"))


@query(
    "input_quality_summary",
    with_ctes(
        FRAMES,
        GTFRAMES,
        SUBMITTED,
        body="SELECT 'events' AS dataset, "
        + ", ".join(f"{R6(f'{fn}({m})')} AS {n}_{m}" for m in QUALITY for n, fn in (("min", "min"), ("max", "max"), ("mean", "avg")))
        + " FROM quality",
    ),
)
def input_quality_summary(spark, sf):
    return rounded(mt.spread(mt.input_quality(submitted_frames(spark, sf)), QUALITY, ["dataset"]))


OUTPUTS = """
outputs AS (SELECT o_orderkey, o_orderpriority AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN 'timeout' END AS error, o_orderkey % 3 <> 0 AS parse_ok, o_orderkey % 5 <> 0 AS format_ok,
  CASE WHEN o_orderkey % 3 = 1 THEN 'line' WHEN o_orderkey % 3 = 2 THEN 'sentence_fallback' END AS parse_mode, o_orderkey % 17 = 0 AS was_output_truncated,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS n_input_tokens, o_custkey % 300 AS n_output_tokens,
  CASE o_orderstatus WHEN 'F' THEN 'missing_items' WHEN 'P' THEN 'wrong_format' END AS failure_reason, o_custkey % 4 + 1 AS top_k,
  CASE WHEN o_custkey % 2 = 0 THEN 'with_doc' ELSE 'no_doc' END AS mode, o_totalprice AS score, o_orderstatus AS task FROM orders)
"""


def outputs(spark, sf):
    """Orders as answer records of one run per priority."""
    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("run_id"),
        F.when(k % 11 == 0, "timeout").alias("error"),
        (k % 3 != 0).alias("parse_ok"),
        (k % 5 != 0).alias("format_ok"),
        F.when(k % 3 == 1, "line").when(k % 3 == 2, "sentence_fallback").alias("parse_mode"),
        (k % 17 == 0).alias("was_output_truncated"),
        F.when(k % 11 != 0, F.floor("o_totalprice").cast("long")).alias("n_input_tokens"),
        (F.col("o_custkey") % 300).alias("n_output_tokens"),
        F.when(F.col("o_orderstatus") == "F", "missing_items").when(F.col("o_orderstatus") == "P", "wrong_format").alias("failure_reason"),
        (F.col("o_custkey") % 4 + 1).alias("top_k"),
        F.when(F.col("o_custkey") % 2 == 0, "with_doc").otherwise("no_doc").alias("mode"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderstatus").alias("task"),
    )


@query(
    "run_counters",
    with_ctes(
        OUTPUTS,
        body="""SELECT run_id, count(*) AS n_total, count(*) FILTER (WHERE error IS NULL) AS n_success, count(error) AS n_error, count(*) FILTER (WHERE parse_ok) AS n_parsed,
        count(*) FILTER (WHERE format_ok) AS n_format_ok, count(*) FILTER (WHERE parse_mode = 'line') AS n_line_mode, count(*) FILTER (WHERE parse_mode = 'sentence_fallback') AS n_fallback,
        count(*) FILTER (WHERE was_output_truncated) AS n_truncated FROM outputs GROUP BY run_id""",
    ),
)
def run_counters(spark, sf):
    return ag.run_counters(outputs(spark, sf), ["run_id"])


@query(
    "truncated_answers",
    with_ctes(OUTPUTS, body="SELECT run_id, o_orderkey FROM outputs WHERE was_output_truncated"),
)
def truncated_answers(spark, sf):
    return outputs(spark, sf).filter("was_output_truncated").select("run_id", "o_orderkey")


@query(
    "failure_histogram",
    with_ctes(OUTPUTS, body="SELECT run_id, failure_reason, count(*) AS n FROM outputs WHERE failure_reason IS NOT NULL GROUP BY ALL"),
)
def failure_histogram(spark, sf):
    return ag.failure_histogram(outputs(spark, sf), ["run_id"])


@query(
    "most_common_top_k",
    with_ctes(
        OUTPUTS,
        body="""SELECT run_id, arg_max(top_k, n * 1000 - top_k) AS top_k_used FROM (SELECT run_id, top_k, count(*) AS n FROM outputs GROUP BY ALL) GROUP BY run_id""",
    ),
)
def most_common_top_k(spark, sf):
    return ag.most_common(outputs(spark, sf), ["run_id"], "top_k", "top_k_used")


@query(
    "position_bias",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        body="""SELECT j.video_id, t.display_pos AS top1_display_position, t.orig_pos AS top1_original_index FROM judged j
        JOIN task_items t ON t.video_id = j.video_id AND t.display_pos = CAST(j.said[1] AS BIGINT) WHERE failure_reason IS NULL""",
    ),
)
def position_bias(spark, sf):
    return bias(spark, sf).drop("dataset")


def bias(spark, sf):
    said = ps.explode_predictions(ps.parse_ranking_reasoned(views.ranking_answers(spark, sf)))
    return ag.position_bias(said, views.task_items(spark, sf))


@query(
    "position_bias_summary",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        body=f"""SELECT 'orders' AS dataset, count(*) AS n, {R6("avg(CAST(said[1] AS BIGINT))")} AS avg_top1_display_position FROM judged WHERE failure_reason IS NULL""",
    ),
)
def position_bias_summary(spark, sf):
    return bias(spark, sf).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("top1_display_position")).alias("avg_top1_display_position")
    )


@query(
    "token_usage",
    with_ctes(
        OUTPUTS,
        body=f"""SELECT run_id, CAST(sum(coalesce(n_input_tokens, 0)) AS BIGINT) AS total_input_tokens, CAST(sum(n_output_tokens) AS BIGINT) AS total_output_tokens,
        min(n_input_tokens) AS min_input_tokens, max(n_input_tokens) AS max_input_tokens, {R6("avg(n_input_tokens)")} AS mean_input_tokens FROM outputs GROUP BY run_id""",
    ),
)
def token_usage(spark, sf):
    return rounded(ag.token_usage(outputs(spark, sf), ["run_id"]))


@query(
    "compare_runs",
    with_ctes(
        OUTPUTS,
        body=f"""SELECT run_id, task, {R6("avg(score) FILTER (WHERE mode = 'no_doc')")} AS no_doc, {R6("avg(score) FILTER (WHERE mode = 'with_doc')")} AS with_doc,
        {R6("avg(score) FILTER (WHERE mode = 'with_doc') - avg(score) FILTER (WHERE mode = 'no_doc')")} AS delta FROM outputs GROUP BY run_id, task""",
    ),
)
def compare_runs(spark, sf):
    return rounded(mt.compare_runs(outputs(spark, sf), "score", ["run_id", "task"]))


@query(
    "union_distinct_sorted",
    with_ctes(
        SENTENCES,
        body="""SELECT video_id, doc_id, row_number() OVER (PARTITION BY video_id ORDER BY doc_id) - 1 AS pos FROM (SELECT DISTINCT s.video_id, d.sentence_id AS doc_id
        FROM sentences s JOIN sentences d ON d.video_id = s.video_id AND d.block = 'document' AND list_has_any(s.shot_ids, d.shot_ids) WHERE s.block = 'summary')""",
    ),
)
def union_distinct_sorted(spark, sf):
    from spanforge.operators.sets import union_distinct_sorted as union

    s = views.sentences(spark, sf)
    linked = joins.overlap_join(s.filter("block = 'summary'"), s.filter("block = 'document'"))
    return union(linked, "doc_id").drop("dataset")
