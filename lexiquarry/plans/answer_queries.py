"""Queries over answers with vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import answers as A
from ..sources.staging import staged
from .fixtures import ANSWER, CLUSTER, table

#: Answers of a document in the fixture; the threshold of its clusters.
EACH, NEAR = 25, 0.2


def answers(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / EACH).alias("doc"),
        (F.col("vec_id") % EACH).alias("idx"),
        F.concat(F.lit("a"), F.col("label").cast("string")).alias("text"),
        (F.expr("(vec_id * 37) % 100") / 100.0).alias("confidence"),
        (F.expr("(vec_id * 53) % 97") / 97.0).alias("chunk_score"),
        V.unit(F.col("embedding")).alias("u"),
    )


def _references(spark, sf):
    return answers(spark, sf).where(F.col("idx") == 0).select("doc", F.col("u").alias("r"))


def _greedy(spark, sf):
    a = answers(spark, sf)
    return a, staged(A.greedy_clusters(a, NEAR))


def q_cosine_pairs(spark, sf):
    return A.pairs(answers(spark, sf)).where("i < j").select("doc", "i", "j", F.round("sim", 6).alias("sim"))


def q_validate_answers(spark, sf):
    found = A.validate(answers(spark, sf), _references(spark, sf), 0.95, 0.1, 3)
    return found.select("doc", "idx", F.round("similarity", 6).alias("similarity"), "place")


def q_validate_lenient(spark, sf):
    a = answers(spark, sf).where("idx > 0")
    return A.validate(a, _references(spark, sf), 0.9, 0.1, 3).select("doc", "idx", F.round("similarity", 6).alias("similarity"), "place")


def q_medoid_answer(spark, sf):
    return A.medoid(answers(spark, sf))


def q_consensus_select(spark, sf):
    return A.consensus(answers(spark, sf), least=NEAR)


def q_consensus_weighted(spark, sf):
    return A.consensus_weighted(answers(spark, sf), least=NEAR)


def q_consensus_simple(spark, sf):
    return A.consensus_simple(answers(spark, sf))


def q_greedy_clusters(spark, sf):
    return _greedy(spark, sf)[1]


def q_cluster_metrics(spark, sf):
    m = A.cluster_metrics(*_greedy(spark, sf))
    return m.select("doc", "cluster", "size", *(F.round(c, 6).alias(c) for c in ("average", "weighted", "cohesion", "greatest")))


def q_select_clustered(spark, sf):
    return A.select_clustered(*_greedy(spark, sf), CLUSTER, ANSWER)


def q_cluster_largest(spark, sf):
    found = A.select_clustered(*_greedy(spark, sf), ["largest"], ["highest_chunk_score"])
    return found.select("doc", "idx", "cluster_size")


def q_cluster_best_single(spark, sf):
    found = A.select_clustered(*_greedy(spark, sf), ["best_single"], ["highest_similarity"])
    return found.select("doc", "idx", "cluster_size")


def q_agglomerative(spark, sf):
    return A.agglomerative(answers(spark, sf))


def q_agglomerative_answer(spark, sf):
    a = answers(spark, sf)
    return A.representatives(a, A.agglomerative(a))


def q_dbscan(spark, sf):
    return A.dbscan(answers(spark, sf), 1 - NEAR, 4)


def q_percentile_groups(spark, sf):
    return A.percentile_groups(answers(spark, sf))


def q_optics(spark, sf):
    return A.optics(answers(spark, sf))


def q_optics_nested(spark, sf):
    """Members of all nested clusters by steep areas of the reachability plot."""
    return A.optics_tree(answers(spark, sf))


def q_near_pairs(spark, sf):
    """Pairs over a threshold, by tiles of four answers a block."""
    found = A.near_pairs(answers(spark, sf), NEAR, 4)
    return found.select("doc", "i", "j", F.round("sim", 6).alias("sim"))


def q_representatives(spark, sf):
    return A.representatives(*_greedy(spark, sf))


def q_dist_percentile(spark, sf):
    return A.distance_percentile(answers(spark, sf))


def q_cluster_rollup(spark, sf):
    r = A.rollup(*_greedy(spark, sf))
    return r.select("doc", "cluster", "size", *(F.round(c, 6).alias(c) for c in ("avg_confidence", "avg_chunk_score", "combined_score", "coherence")), "place")


def q_final_best(spark, sf):
    return A.final_best(*_greedy(spark, sf))


def q_final_weighted(spark, sf):
    return A.final_weighted(*_greedy(spark, sf))


def q_final_ensemble(spark, sf):
    return A.final_ensemble(*_greedy(spark, sf))


def q_chunk_cosine_filter(spark, sf):
    found = A.near_reference(answers(spark, sf), _references(spark, sf))
    return found.select("doc", "idx", F.round("similarity", 6).alias("similarity"))


def q_retrieve_topk(spark, sf):
    return A.retrieve(answers(spark, sf), _references(spark, sf)).select("doc", "idx", "place")


def q_mean_pool(spark, sf):
    tokens = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / EACH).alias("doc"), "embedding", F.expr("int(vec_id % 5 > 0)").alias("mask"))
    pooled = V.masked_mean(tokens, ["doc"], "embedding", "mask")
    return pooled.select("doc", F.posexplode("vector").alias("k", "x"))


def q_hash_embed(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+", -1)).alias("word")).where("word <> ''")
    return V.encode_words(words, ["doc_id"]).select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


_ANS = f"""ans AS (SELECT vec_id // {EACH} AS doc, vec_id % {EACH} AS idx, 'a' || label AS text, ((vec_id * 37) % 100) / 100.0::DOUBLE AS confidence,
    ((vec_id * 53) % 97) / 97.0::DOUBLE AS chunk_score, embedding::DOUBLE[] AS v FROM embeddings),
pr AS (SELECT a.doc, a.idx AS i, b.idx AS j, round(list_cosine_similarity(a.v, b.v), 9) AS sim, b.confidence AS jc, b.chunk_score AS js
  FROM ans a JOIN ans b ON a.doc = b.doc AND a.idx <> b.idx)"""
_WITH = f"WITH RECURSIVE {_ANS}"
_REF = """, sc AS (SELECT a.*, round(list_cosine_similarity(a.v, r.v), 9) AS similarity FROM ans a JOIN ans r ON a.doc = r.doc AND r.idx = 0)"""


def _validated(strict: float, least: float, k: int, where: str = "true") -> str:
    return f"""SELECT doc, idx, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY similarity DESC, idx) AS place,
      max(similarity) OVER (PARTITION BY doc) AS best FROM sc WHERE {where})
      WHERE (best >= {strict} AND similarity >= {strict}) OR (best < {strict} AND similarity >= {least} AND place <= {k})"""


def _first(frame: str, keys: str, order: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {frame}) WHERE rn = 1"


def _consensus(support: str, score: str) -> str:
    return f"""{_WITH}, s AS ({support}), c AS (SELECT a.doc, a.idx, a.text, round({score}, 9) AS consensus_score
      FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM ans) a LEFT JOIN s ON a.doc = s.doc AND a.idx = s.i)
      {_first('c', 'doc', 'consensus_score DESC, idx', 'doc, idx, text, round(consensus_score, 6) AS consensus_score')}"""


_CL = f""", mat AS (SELECT doc, count(*) AS n FROM ans GROUP BY doc),
near AS (SELECT doc, i, list(j) AS js FROM pr WHERE sim >= {NEAR} AND j > i GROUP BY doc, i),
g AS (SELECT doc, n, 0::BIGINT AS i, list_transform(range(0, n), lambda k: -1::BIGINT) AS l FROM mat
  UNION ALL
  SELECT g.doc, n, g.i + 1, CASE WHEN l[g.i + 1] >= 0 THEN l ELSE list_transform(range(0, n), lambda k: CASE WHEN l[k + 1] >= 0 THEN l[k + 1]
    WHEN k = g.i OR list_contains(js, k) THEN g.i ELSE -1 END) END
  FROM g LEFT JOIN near ON g.doc = near.doc AND g.i = near.i WHERE g.i < n),
cl AS (SELECT doc, u.k AS idx, l[u.k + 1] AS cluster FROM g, unnest(range(0, n)) AS u(k) WHERE i = n),
mem AS (SELECT * FROM ans JOIN cl USING (doc, idx)),
ps AS (SELECT doc, a.cluster, i AS idx, count(*) AS peers, sum(sim) AS total FROM pr JOIN cl a USING (doc) JOIN cl b USING (doc)
  WHERE a.idx = i AND b.idx = j AND a.cluster = b.cluster GROUP BY ALL),
met AS (SELECT m.doc, m.cluster, count(*) AS size, round(avg(chunk_score), 9) AS average, round(sum(chunk_score), 9) AS weighted,
    round(coalesce((SELECT sum(total) / sum(peers) FROM ps WHERE ps.doc = m.doc AND ps.cluster = m.cluster), 0), 9) AS cohesion, max(chunk_score) AS greatest
  FROM mem m GROUP BY m.doc, m.cluster)"""
_ROLL = """, roll0 AS (SELECT m.doc, m.cluster, count(*) AS size, round(avg(confidence), 9) AS avg_confidence, round(avg(chunk_score), 9) AS avg_chunk_score,
    (SELECT sum(total) FROM ps WHERE ps.doc = m.doc AND ps.cluster = m.cluster) AS t FROM mem m GROUP BY m.doc, m.cluster),
roll1 AS (SELECT *, round(avg_confidence * avg_chunk_score, 9) AS combined_score, round(CASE WHEN size > 1 THEN 1 - (size * (size - 1) - t) / (size * size) ELSE 1 END, 9) AS coherence FROM roll0),
roll AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(combined_score * coherence, 9) DESC, cluster) AS place FROM roll1)"""
_CLUSTERED = f"{_WITH} {_CL}"


def _chosen(cluster_strategies: dict[str, str], answer_strategies: dict[str, str]) -> str:
    keys = " UNION ALL ".join(f"SELECT *, '{s}' AS cluster_strategy, {k}::DOUBLE AS key FROM met" for s, k in cluster_strategies.items())
    values = " UNION ALL ".join(f"SELECT *, '{s}' AS answer_strategy, round({v}, 9) AS value FROM rowz" for s, v in answer_strategies.items())
    return f""", keyed AS ({keys}), ch AS ({_first('keyed', 'doc, cluster_strategy', 'key DESC, cluster', 'doc, cluster, cluster_strategy, size, average, cohesion')}),
      rowz AS (SELECT mem.doc, mem.idx, mem.text, mem.chunk_score, coalesce(total / peers, 0) AS p, ch.* EXCLUDE (doc) FROM mem JOIN ch USING (doc, cluster)
        LEFT JOIN ps ON mem.doc = ps.doc AND mem.idx = ps.idx), vals AS ({values}),
      tot AS (SELECT doc, count(*) AS total_clusters FROM met GROUP BY doc),
      sel AS ({_first('vals', 'doc, cluster_strategy, answer_strategy', 'value DESC, idx', '*')})"""


_KEYS = {"highest_avg_score": "average", "weighted_score": "weighted", "highest_cohesion": "cohesion"}
_VALUES = {"highest_chunk_score": "chunk_score", "highest_similarity": "p", "combined_score": "0.5::DOUBLE * chunk_score + 0.5::DOUBLE * p"}

SQL = {
    "cosine_pairs": f"{_WITH} SELECT doc, i, j, round(sim, 6) AS sim FROM pr WHERE i < j",
    "near_pairs": f"{_WITH} SELECT doc, i, j, round(sim, 6) AS sim FROM pr WHERE i < j AND sim >= {NEAR}",
    "validate_answers": f"{_WITH} {_REF} {_validated(0.95, 0.1, 3)}",
    "validate_lenient": f"{_WITH} {_REF} {_validated(0.9, 0.1, 3, 'idx > 0')}",
    "medoid_answer": f"""{_WITH}, s AS (SELECT doc, i, sum(sim) AS s FROM pr GROUP BY 1, 2), m AS (SELECT a.doc, idx, text,
        round((coalesce(s, 0) + 1) / count(*) OVER (PARTITION BY a.doc), 9) AS c, avg(confidence) OVER (PARTITION BY a.doc) AS confidence,
        count(*) OVER (PARTITION BY a.doc, text) AS support FROM ans a LEFT JOIN s ON a.doc = s.doc AND a.idx = s.i)
      {_first('m', 'doc', 'c DESC, idx', 'doc, idx, text, round(confidence, 6) AS confidence, support')}""",
    "consensus_select": _consensus(f"SELECT doc, i, avg(sim) AS s FROM pr WHERE sim >= {NEAR} GROUP BY 1, 2", "(chunk_score + confidence) / 2 * 0.6::DOUBLE + coalesce(s, 0) * 0.4::DOUBLE"),
    "consensus_weighted": _consensus(
        f"SELECT doc, i, avg(sim * (js + jc) / 2) AS s FROM pr WHERE sim >= {NEAR} GROUP BY 1, 2", "(chunk_score + confidence) / 2 * 0.6::DOUBLE + coalesce(s, 0) * 0.4::DOUBLE"
    ),
    "consensus_simple": _consensus("SELECT doc, i, sum(sim * (js + jc) / 2) AS s FROM pr GROUP BY 1, 2", "(chunk_score + confidence) / 2 * 0.7::DOUBLE + s / (n - 1) * 0.3::DOUBLE"),
    "greedy_clusters": f"{_CLUSTERED} SELECT * FROM cl",
    "cluster_metrics": f"{_CLUSTERED} SELECT doc, cluster, size, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("average", "weighted", "cohesion", "greatest")) + " FROM met",
    "select_clustered": f"""{_CLUSTERED} {_chosen(_KEYS, _VALUES)} SELECT doc, cluster_strategy, answer_strategy, idx, text, size AS cluster_size, total_clusters,
      round(average, 6) AS cluster_average_score, round(cohesion, 6) AS cluster_cohesion FROM sel JOIN tot USING (doc)""",
    "cluster_largest": f"{_CLUSTERED} {_chosen({'largest': 'size'}, {'highest_chunk_score': 'chunk_score'})} SELECT doc, idx, size AS cluster_size FROM sel",
    "cluster_best_single": f"{_CLUSTERED} {_chosen({'best_single': 'greatest'}, {'highest_similarity': 'p'})} SELECT doc, idx, size AS cluster_size FROM sel",
    "representatives": f"""{_CLUSTERED}, tp AS (SELECT doc, cluster, max(confidence) AS top FROM mem GROUP BY 1, 2), b AS ({_first('tp', 'doc', 'top DESC, cluster', 'doc, cluster, top')}),
      un AS (SELECT mem.doc, cluster, idx, text, top, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS un FROM mem JOIN b USING (doc, cluster)),
      el AS (SELECT doc, idx, unnest(un) AS x, generate_subscripts(un, 1) AS k FROM un), ce AS (SELECT doc, k, avg(x) AS m FROM el GROUP BY 1, 2),
      fa AS (SELECT doc, idx, round(sqrt(sum(pow(x - m, 2))), 9) AS far FROM el JOIN ce USING (doc, k) GROUP BY 1, 2), z AS (SELECT * FROM un JOIN fa USING (doc, idx))
      {_first('z', 'doc', 'far, idx', 'doc, cluster, idx, text, top AS confidence')}""",
    "dist_percentile": f"{_WITH} SELECT doc, round(quantile_cont(1 - sim, 0.75), 6) AS distance FROM pr WHERE i < j GROUP BY doc",
    "cluster_rollup": f"{_CLUSTERED} {_ROLL} SELECT doc, cluster, size, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("avg_confidence", "avg_chunk_score", "combined_score", "coherence"))
    + ", place FROM roll",
    "final_best": f"{_CLUSTERED} {_ROLL}, z AS (SELECT mem.* FROM mem JOIN roll USING (doc, cluster) WHERE place = 1) "
    + _first("z", "doc", "round(confidence * chunk_score, 9) DESC, idx", "doc, idx, text"),
    "final_weighted": f"{_CLUSTERED} {_ROLL}, z AS (SELECT mem.*, coherence, place FROM mem JOIN roll USING (doc, cluster) WHERE place <= 3) "
    + _first("z", "doc", "round(confidence * chunk_score * coherence, 9) DESC, place, idx", "doc, idx, text"),
    "final_ensemble": f"""{_CLUSTERED} {_ROLL}, z AS (SELECT doc, text, round(sum(combined_score * coherence * confidence * chunk_score), 9) AS s, min([place, idx]) AS f
        FROM mem JOIN roll USING (doc, cluster) GROUP BY 1, 2) {_first('z', 'doc', 's DESC, f', 'doc, f[2] AS idx, text, round(s, 6) AS score')}""",
    "chunk_cosine_filter": f"{_WITH} {_REF} SELECT doc, idx, round(similarity, 6) AS similarity FROM sc WHERE similarity >= 0.3",
    "retrieve_topk": f"""{_WITH} {_REF} SELECT doc, idx, place FROM (SELECT doc, idx, similarity, row_number() OVER (PARTITION BY doc ORDER BY similarity DESC, idx)::INT AS place FROM sc WHERE similarity >= 0.0005)
      WHERE place <= 100""",
    "dbscan": f"""{_WITH}, ne AS (SELECT doc, i, j FROM pr WHERE 1 - sim <= {1 - NEAR} UNION ALL SELECT doc, idx, idx FROM ans),
      co AS (SELECT doc, i FROM ne GROUP BY 1, 2 HAVING count(*) >= 4), st AS (SELECT ne.* FROM ne JOIN co USING (doc, i) WHERE (doc, j) IN (SELECT (doc, i) FROM co)),
      re AS (SELECT doc, i, i AS r FROM co UNION SELECT re.doc, st.j, re.r FROM re JOIN st ON re.doc = st.doc AND re.i = st.i),
      lb AS (SELECT doc, i, min(r) AS label FROM re GROUP BY 1, 2)
      SELECT ne.doc, ne.j AS idx, min(label) AS cluster FROM ne JOIN lb USING (doc, i) GROUP BY 1, 2""",
    "percentile_groups": f"""{_WITH}, bo AS (SELECT doc, quantile_cont(round(1 - sim, 9), 0.75) AS bound FROM pr WHERE i < j GROUP BY 1),
      ne AS (SELECT doc, i, list(j) AS js FROM (SELECT doc, i, j FROM pr JOIN bo USING (doc) WHERE round(1 - sim, 9) <= bound UNION ALL SELECT doc, idx, idx FROM ans) GROUP BY 1, 2),
      wk AS (SELECT doc, 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS own FROM bo
        UNION ALL SELECT wk.doc, wk.i + 1, CASE WHEN list_contains(used, wk.i) THEN used ELSE list_concat(used, js) END, CASE WHEN list_contains(used, wk.i) THEN [] ELSE js END
        FROM wk JOIN ne ON wk.doc = ne.doc AND wk.i = ne.i)
      SELECT doc, unnest(own) AS idx, i - 1 AS cluster FROM wk""",
    "mean_pool": f"""WITH t AS (SELECT vec_id // {EACH} AS doc, (vec_id % 5 > 0)::INT AS m, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
      SELECT doc, k::INT AS k, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS x FROM t GROUP BY 1, 2""",
    "hash_embed": r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents),
      b AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 4))::INT % 16 AS b FROM w WHERE w <> ''), c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY 1, 2)
      SELECT doc_id, array_to_string(list_transform(range(0, 16), lambda k: coalesce(map_from_entries(list((b, n)))[k], 0)), ',') AS vector FROM c GROUP BY doc_id""",
}

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
