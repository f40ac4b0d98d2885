"""DuckDB oracle SQL for the registered queries (plain brute force).

The driver registers the test tables as views and runs these strings next to
the Spark queries.  Every oracle scores all pairs directly, ranks with
``row_number`` and computes the metrics from their definitions, so it shares
no code path with the Spark operators.
"""

from __future__ import annotations

DEFAULT_KS = (1, 3, 5, 10, 20, 100, 1000)
TEXT_DIM = 64


def klist(ks) -> str:
    return "[" + ", ".join(str(int(k)) for k in ks) + "]"


def unit(expr: str) -> str:
    """Clamped L2 normalisation of a DOUBLE[] expression."""
    return f"list_transform({expr}, lambda x: x / greatest(sqrt(list_sum(list_transform({expr}, lambda y: y * y))), 1e-12))"


def score_expr(a: str, b: str, norm: bool = True) -> str:
    s = f"list_dot_product({a}, {b})"
    noise = f"WHEN abs({s}) < pow(2, -46) THEN 0.0 " if norm else ""
    return f"CASE WHEN isnan({s}) THEN -1.0 {noise}ELSE {s} END"


def buckets(text: str, dim: str = str(TEXT_DIM)) -> str:
    """md5 bucket of every token (lower-cased, split on spaces / newlines, no empties)."""
    toks = f"list_filter(string_split_regex(lower({text}), '[ \\n]+'), lambda t: length(t) > 0)"
    return f"list_transform({toks}, lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})::INTEGER)"


def counts_vec(hist: str, dim: str = str(TEXT_DIM)) -> str:
    """Dense DOUBLE[] of bucket counts from a histogram map (NULL map -> zeros)."""
    return f"list_transform(range({dim}), lambda i: CAST(coalesce({hist}[i::INTEGER], 0) AS DOUBLE))"


def hashed(name: str, table: str, key: str, dim: str = str(TEXT_DIM), dims: bool = False) -> str:
    """CTEs ``{name}_h(key[, dim], h)``: histogram of token buckets per row of ``table``."""
    if dims:
        return f"""
{name}_b AS (SELECT dims.dim, x.{key}, unnest({buckets('x.text', 'dims.dim')}) AS b FROM {table} x JOIN dims ON TRUE),
{name}_h AS (SELECT dim, {key}, histogram(b) AS h FROM {name}_b GROUP BY dim, {key})"""
    return f"""
{name}_b AS (SELECT {key}, unnest({buckets('text', dim)}) AS b FROM {table}),
{name}_h AS (SELECT {key}, histogram(b) AS h FROM {name}_b GROUP BY {key})"""


# ------------------------------------------------------------------ families
VEC_BASE = f"""
emb AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vq AS (SELECT id AS qid, {unit('v')} AS u FROM emb),
vd AS (SELECT id AS did, {unit('v')} AS u FROM emb),
vec_qrels AS (
  SELECT qid, did, rel FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(d.vec_id AS VARCHAR) AS did,
      CASE WHEN d.label = q.label THEN (CASE WHEN d.vec_id % 3 = 0 THEN 2 ELSE 1 END)
           WHEN d.label = (q.label + 1) % 10 THEN 0 END AS rel
    FROM embeddings q JOIN embeddings d ON d.vec_id <> q.vec_id AND (d.label = q.label OR d.label = (q.label + 1) % 10)
  ) WHERE rel IS NOT NULL)"""


def vec_run(k: int, exclude_identical: bool = True, norm: bool = True, name: str = "run") -> str:
    src_q = "vq" if norm else "(SELECT id AS qid, v AS u FROM emb)"
    src_d = "vd" if norm else "(SELECT id AS did, v AS u FROM emb)"
    cond = "q.qid <> d.did" if exclude_identical else "TRUE"
    return f"""
{name}_all AS (SELECT q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM {src_q} q JOIN {src_d} d ON {cond}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk
           FROM {name}_all) WHERE rk <= {k})"""


TXT_BASE = hashed("bh", "benchmark", "item_id") + "," + hashed("dh", "documents", "doc_id") + f""",
bq AS (SELECT CAST(x.item_id AS VARCHAR) AS qid, x.text, {counts_vec('h.h')} AS v
       FROM benchmark x LEFT JOIN bh_h h ON h.item_id = x.item_id),
dd AS (SELECT CAST(x.doc_id AS VARCHAR) AS did, x.lang AS subset, x.text, {counts_vec('h.h')} AS v
       FROM documents x LEFT JOIN dh_h h ON h.doc_id = x.doc_id),
tq AS (SELECT qid, {unit('v')} AS u FROM bq),
td AS (SELECT did, subset, {unit('v')} AS u FROM dd),
txt_qrels AS (SELECT CAST(b.item_id AS VARCHAR) AS qid, CAST(d.doc_id AS VARCHAR) AS did, 1 AS rel
              FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def txt_run(k: int, by_subset: bool = False, name: str = "run") -> str:
    part = "d.subset, " if by_subset else ""
    pby = "subset, qid" if by_subset else "qid"
    return f"""
{name}_all AS (SELECT {part}q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM tq q JOIN td d ON TRUE),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {pby} ORDER BY round(score, 12) DESC, did DESC) AS rk
           FROM {name}_all) WHERE rk <= {k})"""


MEM_BASE = """
conv_k AS (SELECT *, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id FROM conversations),""" + hashed(
    "ch", "conv_k", "id") + f""",
turns AS (SELECT x.conv_id, x.turn, x.role, x.text, x.id, {counts_vec('h.h')} AS v
          FROM conv_k x LEFT JOIN ch_h h ON h.id = x.id),
mq AS (SELECT id AS qid, conv_id, turn, {unit('v')} AS u FROM turns WHERE role = 'user'),
md AS (SELECT id AS did, conv_id, turn, {unit('v')} AS u FROM turns),
mem_qrels AS (SELECT q.qid, t.id AS did, CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END AS rel
              FROM mq q JOIN turns t ON t.conv_id = q.conv_id AND t.turn = q.turn + 1),
mem_cand AS (SELECT q.qid, d.did FROM mq q JOIN md d ON d.conv_id = q.conv_id),
mem_scored AS (SELECT c.qid, c.did, {score_expr('q.u', 'd.u')} AS score
               FROM mem_cand c JOIN mq q ON q.qid = c.qid JOIN md d ON d.did = c.did),
mem_spoken AS (SELECT c.qid, c.did FROM mem_cand c JOIN turns t ON t.id = c.did WHERE t.role <> 'system')"""


# ------------------------------------------------------------------ metrics
def per_query_sql(run: str, qrels: str, ks, keys: tuple[str, ...] = (), run_qids: str | None = None,
                  name: str = "pq") -> str:
    """CTEs ending in ``{name}(keys, qid, k, ndcg, map, recall, precision, mrr, cv_recall)``."""
    kc = "".join(f"{c}, " for c in keys)
    kj = "".join(f" AND x.{c} = y.{c}" for c in keys)
    kmax = max(ks)
    rq = run_qids or run
    return f"""
{name}_ks AS (SELECT unnest({klist(ks)}) AS k),
{name}_rr AS (SELECT {kc}qid, did, score, row_number() OVER (PARTITION BY {kc}qid ORDER BY round(score, 12) DESC, did DESC) AS rk
              FROM {run}),
{name}_j AS (SELECT x.*, coalesce(y.rel, 0) AS rel, CASE WHEN coalesce(y.rel, 0) > 0 THEN 1 ELSE 0 END AS hit
             FROM (SELECT * FROM {name}_rr WHERE rk <= {kmax}) x
             LEFT JOIN {qrels} y ON x.qid = y.qid AND x.did = y.did{kj}),
{name}_c AS (SELECT *, sum(hit) OVER (PARTITION BY {kc}qid ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chit
             FROM {name}_j),
{name}_h AS (SELECT {kc}qid, k,
               sum(CASE WHEN rk <= k AND rel > 0 THEN rel / log2(rk + 1) ELSE 0 END) AS dcg,
               sum(CASE WHEN rk <= k THEN hit * chit / rk ELSE 0 END) AS ap,
               sum(CASE WHEN rk <= k THEN hit ELSE 0 END) AS nhit,
               max(CASE WHEN rk <= k THEN hit / rk ELSE 0 END) AS rr
             FROM {name}_c JOIN {name}_ks ON TRUE GROUP BY ALL),
{name}_p AS (SELECT {kc}qid, rel, row_number() OVER (PARTITION BY {kc}qid ORDER BY rel DESC) AS irk
             FROM {qrels} WHERE rel > 0),
{name}_i AS (SELECT {kc}qid, k, sum(CASE WHEN irk <= k THEN rel / log2(irk + 1) ELSE 0 END) AS idcg
             FROM {name}_p JOIN {name}_ks ON TRUE GROUP BY ALL),
{name}_n AS (SELECT {kc}qid, count(*) AS r FROM {qrels} WHERE rel > 0 GROUP BY ALL),
{name}_s AS (SELECT DISTINCT {kc}qid FROM {rq} x WHERE EXISTS (SELECT 1 FROM {qrels} y WHERE y.qid = x.qid{kj})),
{name} AS (
  SELECT {''.join(f's.{c}, ' for c in keys)}s.qid, ks.k,
    coalesce(h.dcg / nullif(i.idcg, 0), 0) AS ndcg,
    coalesce(h.ap / nullif(n.r, 0), 0) AS map,
    coalesce(h.nhit / nullif(n.r, 0), 0) AS recall,
    coalesce(h.nhit, 0) / ks.k AS precision,
    coalesce(h.rr, 0) AS mrr,
    CASE WHEN coalesce(h.nhit, 0) > 0 THEN 1.0 ELSE 0.0 END AS cv_recall
  FROM {name}_s s JOIN {name}_ks ks ON TRUE
  LEFT JOIN {name}_h h ON h.qid = s.qid AND h.k = ks.k{''.join(f' AND h.{c} = s.{c}' for c in keys)}
  LEFT JOIN {name}_i i ON i.qid = s.qid AND i.k = ks.k{''.join(f' AND i.{c} = s.{c}' for c in keys)}
  LEFT JOIN {name}_n n ON n.qid = s.qid{''.join(f' AND n.{c} = s.{c}' for c in keys)})"""


def long_sql(pq: str, name: str = "lq") -> str:
    return f"""
{name}_u AS (UNPIVOT {pq} ON ndcg, map, recall, precision, mrr, cv_recall INTO NAME metric VALUE value),
{name} AS (SELECT * REPLACE (round(value, 9) AS value) FROM {name}_u)"""


def mean_sql(lq: str, keys: tuple[str, ...] = ()) -> str:
    kc = "".join(f"{c}, " for c in keys)
    return f"SELECT {kc}metric, k, round(avg(value), 9) AS value FROM {lq} GROUP BY ALL"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes if c)



def nauc_sql(run: str, lq: str) -> str:
    """nAUC of ndcg/map/recall/precision/mrr per (metric, k, signal) from long per-query rows."""
    return f"""
conf AS (SELECT qid, round(max(score), 9) AS cmax, round(stddev_pop(score), 9) AS cstd,
           round(coalesce(max(CASE WHEN rk = 1 THEN score END) - max(CASE WHEN rk = 2 THEN score END), 0), 9) AS cdiff1
         FROM {run} GROUP BY qid),
lqc AS (SELECT l.*, c.cmax, c.cstd, c.cdiff1 FROM {lq} l LEFT JOIN conf c ON c.qid = l.qid
        WHERE l.metric IN ('ndcg', 'map', 'recall', 'precision', 'mrr')),
sig AS (SELECT metric, k, qid, value, 'max' AS signal, coalesce(cmax, 0) AS sortkey FROM lqc
        UNION ALL SELECT metric, k, qid, value, 'std', coalesce(cstd, 0) FROM lqc
        UNION ALL SELECT metric, k, qid, value, 'diff1', coalesce(cdiff1, 0) FROM lqc
        UNION ALL SELECT metric, k, qid, value, 'oracle', value FROM lqc),
pos AS (SELECT *, row_number() OVER (PARTITION BY metric, k, signal ORDER BY sortkey, qid) - 1 AS pos,
               count(*) OVER (PARTITION BY metric, k, signal) AS n FROM sig),
rates AS (SELECT unnest(range(10)) AS i),
curve AS (SELECT metric, k, signal, i,
            sum(CASE WHEN pos >= least(round_even(CAST(i AS DOUBLE) * 0.1::DOUBLE * n, 0), n - 1) THEN value ELSE 0 END)
            / (n - least(round_even(CAST(i AS DOUBLE) * 0.1::DOUBLE * n, 0), n - 1)) AS c
          FROM pos JOIN rates ON TRUE GROUP BY metric, k, signal, i, n),
area AS (SELECT metric, k, signal, sum(dx * (c + nc) / 2.0) AS auc, max(CASE WHEN i = 0 THEN c END) AS c0 FROM (
           SELECT *, lead(c) OVER (PARTITION BY metric, k, signal ORDER BY i) AS nc,
                  CAST(i + 1 AS DOUBLE) * 0.1::DOUBLE - CAST(i AS DOUBLE) * 0.1::DOUBLE AS dx FROM curve) GROUP BY ALL),
nres AS (SELECT s.metric, s.k, s.signal, s.auc, o.auc AS or_auc, o.c0 * 0.9::DOUBLE AS flat
         FROM area s JOIN area o ON o.metric = s.metric AND o.k = s.k AND o.signal = 'oracle' WHERE s.signal <> 'oracle')"""


NAUC_SELECT = ("SELECT metric, k, signal, round(CASE WHEN abs(or_auc - flat) < 1e-12 THEN NULL "
               "ELSE (auc - flat) / (or_auc - flat) END, 9) AS value FROM nres")

# ------------------------------------------------------------------ registry
RUN_COLS = "SELECT qid, did, round(score, 9) AS score, CAST(rk AS INTEGER) AS rk FROM run"
KS4 = (1, 3, 5, 10)


def _vec_metrics(ks=KS4) -> str:
    return with_(VEC_BASE, vec_run(10), per_query_sql("run", "vec_qrels", ks), long_sql("pq")) + "\n" + mean_sql("lq")


COSINE_TOPK = with_(VEC_BASE, vec_run(10)) + "\n" + RUN_COLS

ZERO_NAN = with_(f"""
dimc AS (SELECT max(len(embedding)) AS dim FROM embeddings),
allv AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
         UNION ALL SELECT 'z0', list_transform(range(dim), lambda i: 0.0::DOUBLE) FROM dimc
         UNION ALL SELECT 'n0', list_transform(range(dim), lambda i: CASE WHEN i = 0 THEN 'NaN'::DOUBLE ELSE 0.1 END) FROM dimc
         UNION ALL SELECT 'd9', list_transform(range(dim), lambda i: 0.125::DOUBLE) FROM dimc
         UNION ALL SELECT 'd10', list_transform(range(dim), lambda i: 0.125::DOUBLE) FROM dimc),
uq AS (SELECT id AS qid, {unit('v')} AS u FROM allv),
ud AS (SELECT id AS did, {unit('v')} AS u FROM allv),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM (
          SELECT q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM uq q JOIN ud d ON q.qid <> d.did)) WHERE rk <= 5)""") + "\n" + RUN_COLS

TXT_SUBSET_QRELS = """
qrels_sub AS (SELECT d.subset, q.qid, q.did, q.rel FROM txt_qrels q JOIN td d ON d.did = q.did)"""


def _txt_subset_metrics(k, ks) -> str:
    return with_(TXT_BASE, txt_run(k, by_subset=True), TXT_SUBSET_QRELS,
                 per_query_sql("run", "qrels_sub", ks, keys=("subset",)), long_sql("pq"))


MEM_CAND_SCORED = """
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk
        FROM mem_scored) WHERE rk <= 10)"""

MEM_STRICT = """
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk
        FROM mem_scored r WHERE EXISTS (SELECT 1 FROM mem_spoken c WHERE c.qid = r.qid AND c.did = r.did)) WHERE rk <= 10)"""

MEM_LENIENT = """
sysconv AS (SELECT DISTINCT conv_id FROM turns WHERE role = 'system'),
cand_sys AS (SELECT c.qid, c.did FROM mem_spoken c JOIN mq q ON q.qid = c.qid WHERE q.conv_id IN (SELECT conv_id FROM sysconv)),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM mem_scored r
        WHERE EXISTS (SELECT 1 FROM cand_sys c WHERE c.qid = r.qid AND c.did = r.did)
        OR r.qid NOT IN (SELECT qid FROM cand_sys))"""

ORACLES = {
    "flagship_eval": _vec_metrics(),
    "cosine_topk": COSINE_TOPK,
    "dot_topk": with_(VEC_BASE, vec_run(10, norm=False)) + "\n" + RUN_COLS,
    "blocked_topk": COSINE_TOPK,
    "chunk_merge_topk": COSINE_TOPK,
    "zero_vector_and_nan": ZERO_NAN,
    "nauc_all": with_(VEC_BASE, vec_run(10), per_query_sql("run", "vec_qrels", KS4), long_sql("pq"),
                      nauc_sql("run", "lq")) + "\n" + NAUC_SELECT,
    "metrics_all_k": with_(VEC_BASE, vec_run(1000), per_query_sql("run", "vec_qrels", DEFAULT_KS), long_sql("pq"))
    + "\nSELECT qid, metric, k, value FROM lq",
    "topk_ties": with_(TXT_BASE, """
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM (
          SELECT q.did AS qid, d.did, """ + score_expr("q.u", "d.u") + """ AS score FROM td q JOIN td d ON q.did <> d.did))
        WHERE rk <= 5)""") + "\n" + RUN_COLS,
    "embed_and_search": with_(TXT_BASE, txt_run(10)) + "\n" + RUN_COLS,
    "hashed_embedding": with_(TXT_BASE) + """
SELECT did, CAST(bucket AS INTEGER) AS bucket, cnt FROM (SELECT did, unnest(range(len(v))) AS bucket, unnest(v) AS cnt FROM dd)
WHERE cnt > 0""",
    "contains_qrels": with_(TXT_BASE) + "\nSELECT qid, did, rel FROM txt_qrels",
    "metrics_by_subset": _txt_subset_metrics(100, (1, 3, 5, 10, 20, 100)) + "\n" + mean_sql("lq", ("subset",)),
    "main_score": _txt_subset_metrics(10, (10,)) + """
SELECT subset, 'ndcg_at_10' AS main_metric, round(avg(value), 9) AS value FROM lq WHERE metric = 'ndcg' AND k = 10
GROUP BY subset""",
    "mean_by_denominator": with_(TXT_BASE, txt_run(1000), per_query_sql("run", "txt_qrels", DEFAULT_KS), long_sql("pq"))
    + """
SELECT metric, k, round(avg(value), 9) AS value, 'evaluated' AS denominator FROM lq GROUP BY ALL
UNION ALL
SELECT metric, k, round(sum(value) / (SELECT count(DISTINCT qid) FROM txt_qrels), 9) AS value, 'qrels' AS denominator
FROM lq GROUP BY ALL""",
    "candidates_pre": with_(MEM_BASE, MEM_CAND_SCORED) + "\n" + RUN_COLS,
    "candidates_post_strict": with_(MEM_BASE, MEM_STRICT) + "\n" + RUN_COLS,
    "candidates_post_lenient": with_(MEM_BASE, MEM_LENIENT) + "\n" + RUN_COLS,
    "skip_first": with_(VEC_BASE, vec_run(11, exclude_identical=False))
    + "\nSELECT qid, did, round(score, 9) AS score, CAST(rk - 1 AS INTEGER) AS rk FROM run WHERE rk > 1",
    "ignore_identical": with_(VEC_BASE, vec_run(11, exclude_identical=False))
    + "\nSELECT qid, did, round(score, 9) AS score, CAST(rk AS INTEGER) AS rk FROM run WHERE qid <> did",
}


# ------------------------------------------------------------------ batch 2
def _md5_len(expr: str, name: str) -> str:
    return f"CAST(length({expr}) AS BIGINT) AS {name}_len, md5({expr}) AS {name}_md5"


COMPOSE_TEXT = """
SELECT did, CAST(length(t) AS BIGINT) AS text_len, md5(t) AS text_md5 FROM (
  SELECT did, concat(coalesce(title, ''), ' ', coalesce(text, '')) AS t FROM (
    SELECT CAST(doc_id AS VARCHAR) AS did, CASE WHEN lang = 'en' THEN NULL ELSE source END AS title, text FROM documents
    UNION ALL SELECT DISTINCT 't-' || lang, lang, NULL FROM documents
    UNION ALL SELECT DISTINCT 'n-' || lang, NULL, NULL FROM documents))"""

# conversations are stored in (conv_id, turn) order, so the last row of a
# conversation in file order is its largest turn
DEDUPE = """
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"""

DROP_RENAME = "SELECT CAST(doc_id AS VARCHAR) AS id, lang, md5(text) AS data_md5 FROM documents"

QRELS_PACK = with_(TXT_BASE, MEM_BASE) + """
SELECT qid AS id, '{' || string_agg('"' || did || '":' || CAST(rel AS VARCHAR), ',' ORDER BY did) || '}' AS data
FROM (SELECT * FROM mem_qrels UNION ALL SELECT * FROM txt_qrels) GROUP BY qid"""

QRELS_EXPLODE = """
SELECT CAST(event_id AS VARCHAR) AS qid, did, CAST(json_extract_string(props, '$."' || did || '"') AS INTEGER) AS rel
FROM (SELECT event_id, props, unnest(json_keys(props)) AS did FROM events)"""

SEQUENCE_FLATTEN = """
WITH s AS (
  SELECT page_id, [
    {'text': url, 'path': NULL::VARCHAR, 'package': NULL::VARCHAR},
    {'text': NULL::VARCHAR, 'path': 'img/' || CAST(page_id AS VARCHAR) || '.png',
     'package': CASE WHEN starts_with(url, 'https') THEN 'secure' END},
    {'text': html, 'path': NULL::VARCHAR, 'package': NULL::VARCHAR},
    {'text': NULL::VARCHAR, 'path': 'thumb/' || CAST(page_id AS VARCHAR) || '.png', 'package': 'thumbs'}] AS items
  FROM pages),
f AS (SELECT page_id,
        array_to_string(list_transform(list_filter(items, lambda i: i.text IS NOT NULL), lambda i: i.text || ' '), '') AS t,
        list_filter(items, lambda i: i.path IS NOT NULL)[1] AS img
      FROM s)
SELECT page_id, CAST(length(t) AS BIGINT) AS seq_len, md5(t) AS seq_md5, img.path AS image_path,
       coalesce(nullif(img.package, ''), 'images') AS image_package FROM f"""

MODALITY = """
SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, 'TEXT' AS modal, 0 AS grp FROM documents
UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), 'IMAGE', 1 FROM pages
UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'SEQ', 2 FROM conversations"""

PROMPT = """
SELECT id, prompt, md5(coalesce(prompt, '') || text) AS input_md5 FROM (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text,
    CASE WHEN role = 'user' THEN 'Q: '
         WHEN role <> 'system' THEN 'Represent: '
         ELSE 'D: ' END AS prompt
  FROM conversations)"""

AUDIT = with_(MEM_BASE, """
later AS (SELECT c.qid, c.did FROM mem_cand c JOIN turns t ON t.id = c.did JOIN mq q ON q.qid = c.qid
          WHERE t.role = 'assistant' AND t.turn > q.turn),
filt AS (SELECT qid, did FROM later WHERE qid <> did)""") + """
SELECT 'only_in_run' AS "check", qid FROM (SELECT DISTINCT qid FROM filt EXCEPT SELECT DISTINCT qid FROM mem_qrels)
UNION ALL SELECT 'only_in_qrels', qid FROM (SELECT DISTINCT qid FROM mem_qrels EXCEPT SELECT DISTINCT qid FROM filt)
UNION ALL SELECT 'no_positive', qid FROM (SELECT DISTINCT qid FROM mem_qrels
                                          EXCEPT SELECT DISTINCT qid FROM mem_qrels WHERE rel > 0)
UNION ALL SELECT 'empty_hits', qid FROM (SELECT DISTINCT qid FROM mq EXCEPT SELECT DISTINCT qid FROM filt)
UNION ALL SELECT 'empty_candidates', qid FROM (SELECT DISTINCT qid FROM mq EXCEPT SELECT DISTINCT qid FROM later)"""

STATS = with_(TXT_BASE, MEM_BASE) + """
SELECT family, nq + nd AS n_samples, nd AS num_documents, nq AS num_queries,
       round(dl, 9) AS average_document_length, round(ql, 9) AS average_query_length,
       round(coalesce(nrel, 0) / nq, 9) AS average_relevant_docs_per_query FROM (
  SELECT 'TXT' AS family, (SELECT count(*) FROM bq) AS nq, (SELECT avg(length(text)) FROM bq) AS ql,
         (SELECT count(*) FROM dd) AS nd, (SELECT avg(length(text)) FROM dd) AS dl,
         (SELECT sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) FROM txt_qrels) AS nrel
  UNION ALL
  SELECT 'MEM', (SELECT count(*) FROM turns WHERE role = 'user'), (SELECT avg(length(text)) FROM turns WHERE role = 'user'),
         (SELECT count(*) FROM turns), (SELECT avg(length(text)) FROM turns),
         (SELECT sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) FROM mem_qrels))"""

LOAD_COUNTS = with_(TXT_BASE, MEM_BASE) + """
SELECT 'TXT' AS family, 'query' AS side, count(*) AS n FROM bq
UNION ALL SELECT 'TXT', 'corpus', count(*) FROM dd
UNION ALL SELECT 'TXT', 'qrels', count(*) FROM txt_qrels
UNION ALL SELECT 'MEM', 'query', count(*) FROM mq
UNION ALL SELECT 'MEM', 'corpus', count(*) FROM md
UNION ALL SELECT 'MEM', 'qrels', count(*) FROM mem_qrels"""

LATE_FUSION = with_(TXT_BASE, f"""
tagged AS (SELECT doc_id, concat_ws(' ', source, lang) AS text FROM documents),""" + hashed("gh", "tagged", "doc_id") + f""",
fz AS (SELECT d.did AS id, list_transform(range({TEXT_DIM}), lambda i: d.v[i + 1] + g.v[i + 1]) AS v
       FROM dd d JOIN (SELECT CAST(x.doc_id AS VARCHAR) AS id, {counts_vec('h.h')} AS v
                       FROM tagged x LEFT JOIN gh_h h ON h.doc_id = x.doc_id) g ON g.id = d.did),
fu AS (SELECT id, {unit('v')} AS u FROM fz),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM (
          SELECT q.id AS qid, d.id AS did, {score_expr('q.u', 'd.u')} AS score FROM fu q JOIN fu d ON q.id <> d.id))
        WHERE rk <= 5)""") + "\n" + RUN_COLS


def _toks(t: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({t}), '[ \\n]+'), lambda x: length(x) > 0))"


PAIR_SCORING = with_(MEM_BASE, f"""
pairs AS (SELECT c.qid, c.did, {_toks('tq.text')} AS a, {_toks('td.text')} AS b
          FROM mem_cand c JOIN turns tq ON tq.id = c.qid JOIN turns td ON td.id = c.did),
scored AS (SELECT qid, did, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
             ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score FROM pairs),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk
        FROM scored) WHERE rk <= 5)""") + "\n" + RUN_COLS

HOOK = with_(MEM_BASE, MEM_CAND_SCORED, per_query_sql("run", "mem_qrels", KS4, run_qids="mq"), long_sql("pq"), """
lp AS (SELECT k, avg(s / k) AS value FROM (
         SELECT r.qid, ks.k, sum(CASE WHEN r.rk <= ks.k AND t.role = 'assistant' THEN 1.0 ELSE 0.0 END) AS s
         FROM run r JOIN turns t ON t.id = r.did JOIN (SELECT unnest([1, 3, 5, 10]) AS k) ks ON TRUE
         GROUP BY r.qid, ks.k) GROUP BY k)""") + """
SELECT metric, k, round(avg(value), 9) AS value FROM lq GROUP BY ALL
UNION ALL SELECT 'assistant_share', k, round(value, 9) FROM lp"""


def _metrics_wide() -> str:
    cols = ", ".join(
        f"max(CASE WHEN name = '{m}_at_{k}' THEN value END) AS {m}_at_{k}"
        for m in ("ndcg", "map", "recall", "precision", "mrr", "cv_recall") for k in KS4
    )
    return with_(VEC_BASE, vec_run(10), per_query_sql("run", "vec_qrels", KS4), long_sql("pq"), """
means AS (SELECT metric || '_at_' || CAST(k AS VARCHAR) AS name, round(avg(value), 9) AS value FROM lq GROUP BY metric, k)""") + f"""
SELECT 'VEC' AS task, {cols} FROM means"""


def _sweep() -> str:
    return with_("""
dims AS (SELECT unnest([16, 32, 64]) AS dim),
conv_k AS (SELECT *, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id FROM conversations),"""
                 + hashed("sbh", "benchmark", "item_id", dims=True) + ","
                 + hashed("sdh", "documents", "doc_id", dims=True) + ","
                 + hashed("sch", "conv_k", "id", dims=True) + f""",
sbv AS (SELECT dims.dim, CAST(b.item_id AS VARCHAR) AS qid, {counts_vec('h.h', 'dims.dim')} AS v
        FROM benchmark b JOIN dims ON TRUE LEFT JOIN sbh_h h ON h.dim = dims.dim AND h.item_id = b.item_id),
sdv AS (SELECT dims.dim, CAST(d.doc_id AS VARCHAR) AS did, {counts_vec('h.h', 'dims.dim')} AS v
        FROM documents d JOIN dims ON TRUE LEFT JOIN sdh_h h ON h.dim = dims.dim AND h.doc_id = d.doc_id),
stq AS (SELECT dim, qid, {unit('v')} AS u FROM sbv),
std AS (SELECT dim, did, {unit('v')} AS u FROM sdv),
tqr AS (SELECT dims.dim, CAST(b.item_id AS VARCHAR) AS qid, CAST(d.doc_id AS VARCHAR) AS did, 1 AS rel
        FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN dims ON TRUE),
trun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim, qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM (
           SELECT q.dim, q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM stq q JOIN std d ON q.dim = d.dim))
         WHERE rk <= 10),
stv AS (SELECT dims.dim, c.conv_id, c.turn, c.role, c.id, {counts_vec('h.h', 'dims.dim')} AS v
        FROM conv_k c JOIN dims ON TRUE LEFT JOIN sch_h h ON h.dim = dims.dim AND h.id = c.id),
smq AS (SELECT dim, id AS qid, conv_id, turn, {unit('v')} AS u FROM stv WHERE role = 'user'),
smd AS (SELECT dim, id AS did, conv_id, turn, {unit('v')} AS u FROM stv),
mqr AS (SELECT q.dim, q.qid, t.id AS did, CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END AS rel
        FROM smq q JOIN stv t ON t.dim = q.dim AND t.conv_id = q.conv_id AND t.turn = q.turn + 1),
mrun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim, qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM (
           SELECT q.dim, q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM smq q JOIN smd d
           ON d.dim = q.dim AND d.conv_id = q.conv_id))
         WHERE rk <= 10)""",
                 per_query_sql("trun", "tqr", (10,), keys=("dim",), name="tp"),
                 per_query_sql("mrun", "mqr", (10,), keys=("dim",), name="mp"), """
res AS (SELECT 'hashed-' || CAST(dim AS VARCHAR) AS model, 'TXT' AS task, round(avg(round(ndcg, 9)), 9) AS value
        FROM tp GROUP BY dim
        UNION ALL
        SELECT 'hashed-' || CAST(dim AS VARCHAR), 'MEM', round(avg(round(ndcg, 9)), 9) FROM mp GROUP BY dim)""") + """
SELECT model, max(CASE WHEN task = 'MEM' THEN value END) AS MEM, max(CASE WHEN task = 'TXT' THEN value END) AS TXT
FROM res GROUP BY model"""


ORACLES.update({
    "compose_text": COMPOSE_TEXT,
    "dedupe_last_wins": DEDUPE,
    "drop_rename": DROP_RENAME,
    "qrels_json_pack": QRELS_PACK,
    "qrels_json_explode": QRELS_EXPLODE,
    "sequence_flatten": SEQUENCE_FLATTEN,
    "modality_groups": MODALITY,
    "prompt_resolution": PROMPT,
    "run_qrels_audit": AUDIT,
    "dataset_stats": STATS,
    "load_counts": LOAD_COUNTS,
    "late_fusion": LATE_FUSION,
    "pair_scoring": PAIR_SCORING,
    "custom_metric_hook": HOOK,
    "metrics_wide": _metrics_wide(),
    "sweep_report": _sweep(),
    "stream_topk": COSINE_TOPK,
})


RESUME_PLAN = _txt_subset_metrics(10, (10,)) + """,
done AS (SELECT subset, round(avg(value), 9) AS v FROM lq WHERE metric = 'ndcg' AND k = 10 GROUP BY subset)
SELECT 'hashed-64' AS model, 'TXT' AS task, subset, 'done' AS status, v AS ndcg_at_10 FROM done
UNION ALL
SELECT m.model, 'TXT', s.subset, 'pending', NULL::DOUBLE
FROM (SELECT DISTINCT lang AS subset FROM documents) s JOIN (SELECT unnest(['hashed-16', 'hashed-32']) AS model) m ON TRUE"""

ORACLES["resume_plan"] = RESUME_PLAN


# ------------------------------------------------------------------ batch 3: files, packages, lifecycle
KS3 = (1, 3, 10)

FILES = with_(MEM_BASE) + """
SELECT 'query' AS kind, '' AS subset, CAST(item_id AS VARCHAR) AS id, md5(text) AS value FROM benchmark
UNION ALL SELECT 'corpus', 'lang=' || lang, CAST(doc_id AS VARCHAR), md5(concat(coalesce(source, ''), ' ', coalesce(text, '')))
FROM documents WHERE lang <> 'en'
UNION ALL SELECT kind, '', qid || '>' || did, CAST(rel AS VARCHAR)
FROM mem_qrels, (SELECT unnest(['quoted', 'strict']) AS kind)"""

CANDIDATE_FILES = with_(MEM_BASE) + """
SELECT kind, qid, did FROM mem_cand, (SELECT unnest(['lines', 'array']) AS kind)"""

PACKAGES = """
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, md5(html) AS content_md5 FROM pages"""

LATER = """
later AS (SELECT c.qid, c.did FROM mem_cand c JOIN md d ON d.did = c.did JOIN mq q ON q.qid = c.qid WHERE d.turn > q.turn)"""


def _ranked(scored: str, k: int, name: str) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM {scored})
          WHERE rk <= {k})"""


LIFECYCLE_CANDIDATES = with_(MEM_BASE, LATER, """
hs AS (SELECT s.* FROM mem_scored s JOIN later l ON l.qid = s.qid AND l.did = s.did)""", _ranked("hs", 10, "hrun"), f"""
os AS (SELECT qid, did, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
         ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score
       FROM (SELECT l.qid, l.did, {_toks('tq.text')} AS a, {_toks('td.text')} AS b
             FROM later l JOIN turns tq ON tq.id = l.qid JOIN turns td ON td.id = l.did))""", _ranked("os", 10, "orun"),
                             per_query_sql("hrun", "mem_qrels", KS3, run_qids="mq", name="hp"), long_sql("hp", "hl"),
                             per_query_sql("orun", "mem_qrels", KS3, run_qids="mq", name="op"), long_sql("op", "ol")) + """
SELECT 'hashed' AS model, metric, k, round(avg(value), 9) AS value FROM hl GROUP BY ALL
UNION ALL SELECT 'overlap', metric, k, round(avg(value), 9) FROM ol GROUP BY ALL"""

LIFECYCLE_RESUME = _txt_subset_metrics(10, KS3) + """,
means AS (SELECT subset, metric, k, round(avg(value), 9) AS value FROM lq GROUP BY ALL)
SELECT 'first' AS run, * FROM means WHERE subset = 'en'
UNION ALL SELECT 'both', * FROM means"""

TASK_TEXT = with_("""
prompted AS (SELECT item_id, 'find: ' || text AS text FROM benchmark)""", TXT_BASE.replace("FROM benchmark)", "FROM prompted)", 1).replace(
    "FROM benchmark x", "FROM prompted x", 1), txt_run(10), per_query_sql("run", "txt_qrels", KS3, run_qids="bq"), long_sql("pq")) + "\n" + mean_sql("lq")

TASK_MIXED = with_(MEM_BASE, f"""
mixq AS (SELECT qid, list_append(t.v, 0.0) AS v FROM mq JOIN turns t ON t.id = mq.qid),
mixd AS (SELECT id AS did, list_append(CASE WHEN turn % 3 = 2 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE v END,
                  CASE WHEN turn % 3 = 0 THEN 0.0 ELSE octet_length(encode(text)) / 100.0 END) AS v FROM turns),
xq AS (SELECT qid, {unit('v')} AS u FROM mixq),
xd AS (SELECT did, {unit('v')} AS u FROM mixd),
xs AS (SELECT q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM xq q JOIN xd d ON TRUE)""", _ranked("xs", 10, "run"),
                   per_query_sql("run", "mem_qrels", KS3, run_qids="mq"), long_sql("pq")) + "\n" + mean_sql("lq")

CUSTOM_SEARCH = with_(MEM_BASE, LATER, f"""
cq AS (SELECT qid FROM mq WHERE turn > 0),
ds AS (SELECT c.qid, c.did, {score_expr('q.v', 'd.v', norm=False)} AS score
       FROM mem_cand c JOIN turns q ON q.id = c.qid JOIN turns d ON d.id = c.did),
kept AS (SELECT * FROM ds r WHERE r.qid NOT IN (SELECT qid FROM cq)
         OR EXISTS (SELECT 1 FROM later l WHERE l.qid = r.qid AND l.did = r.did))""", _ranked("kept", 11, "deep"), """
hits AS (SELECT qid, did, score FROM deep WHERE qid <> did)""", _ranked("hits", 10, "run"),
                      per_query_sql("run", "mem_qrels", KS3, run_qids="mq"), long_sql("pq")) + "\n" + mean_sql("lq")

ORACLES.update({
    "files_round_trip": FILES,
    "candidates_round_trip": CANDIDATE_FILES,
    "packages_fetch": PACKAGES,
    "lifecycle_candidates": LIFECYCLE_CANDIDATES,
    "lifecycle_resume": LIFECYCLE_RESUME,
    "task_from_config_text": TASK_TEXT,
    "task_from_config_mixed": TASK_MIXED,
    "custom_search": CUSTOM_SEARCH,
})


LIFECYCLE_EMPTY = with_(MEM_BASE, f"""
sq AS (SELECT qid, u, CASE WHEN conv_id % 2 = 1 THEN 'odd' ELSE '' END AS subset FROM mq),
sr AS (SELECT s.subset, r.* FROM mem_qrels r JOIN sq s USING (qid)),
scored AS (SELECT q.subset, q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM sq q JOIN md d ON q.subset = 'odd' AND d.conv_id % 2 = 1)""",
                        per_query_sql("scored", "sr", KS3, keys=("subset",), run_qids="sq"), long_sql("pq")) + """,
means AS (SELECT subset, metric, k, round(avg(value), 9) AS value FROM lq GROUP BY ALL)
SELECT 'first' AS run, * FROM means UNION ALL SELECT 'again', * FROM means"""

CLASS_JUDGMENTS = with_(VEC_BASE, vec_run(10), per_query_sql("run", "vec_qrels", KS3), long_sql("pq")) + """
SELECT metric, k, round(sum(value) / (SELECT count(DISTINCT qid) FROM vec_qrels), 9) AS value FROM lq GROUP BY ALL
UNION ALL
SELECT 'mean_grade', k, round(avg(v), 9) FROM (
  SELECT qid, k, sum(CASE WHEN rk <= k THEN rel ELSE 0 END) / k AS v FROM pq_j JOIN pq_ks ON TRUE GROUP BY qid, k) GROUP BY k"""

RERANK = with_(MEM_BASE, f"""
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did DESC) AS rk FROM (
           SELECT q.qid, d.did, {score_expr('q.u', 'd.u')} AS score FROM mq q JOIN md d ON TRUE)) WHERE rk <= 20),
os AS (SELECT qid, did, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
         ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score
       FROM (SELECT l.qid, l.did, {_toks('tq.text')} AS a, {_toks('td.text')} AS b
             FROM near l JOIN turns tq ON tq.id = l.qid JOIN turns td ON td.id = l.did))""",
               _ranked("os", 10, "orun"), per_query_sql("orun", "mem_qrels", KS3, run_qids="mq"), long_sql("pq")) + "\n" + mean_sql("lq")

ORACLES.update({"lifecycle_empty": LIFECYCLE_EMPTY, "class_judgments": CLASS_JUDGMENTS, "rerank": RERANK})
