"""MinHash signatures and similarity joins over word sets of documents."""

from pyspark.sql import functions as F

from ..functions.scalar import text_key_sql, universal_hash_sql
from ..operators import similarity as S
from ..sources.catalog import Catalog
from .registry import query

_SETS = r"sets AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents), s AS (SELECT * FROM sets WHERE token <> '')"
_ALL = r"all_ AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents)"
# equal word sets are represented by their smallest id
_REPS = f"""{_ALL}, cls AS (SELECT id, min(id) OVER (PARTITION BY set_) AS rep FROM (SELECT id, string_agg(token, ' ' ORDER BY token) AS set_ FROM all_ WHERE token <> '' GROUP BY id)),
    s AS (SELECT a.* FROM all_ a JOIN cls USING (id) WHERE id = rep AND token <> '')"""
_MEMBERS = "UNION ALL SELECT rep, id, 1.0::DOUBLE FROM cls WHERE id <> rep"
_MIN = ", ".join(f"min({universal_hash_sql('x', i, 15_485_863)})::BIGINT AS h{i}" for i in range(S.HASHES))
_SIG = f"{_SETS}, x AS (SELECT id, {text_key_sql('token')} AS x FROM s), sig AS (SELECT id, count(*)::BIGINT AS n, {_MIN} FROM x GROUP BY id)"
_BANDS = " UNION ALL ".join(f"SELECT {k} AS band, id, h{2 * k} AS u, h{2 * k + 1} AS v FROM sig" for k in range(S.BANDS))
_JACCARD = """
    both_ AS (SELECT p.a, p.b, count(*) AS i FROM cand p JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b AND x.token = y.token GROUP BY p.a, p.b),
    size AS (SELECT id, count(*) AS n FROM s GROUP BY id)
    SELECT j.a AS a, j.b AS b, round(j.i / (m.n + o.n - j.i)::DOUBLE, 6) AS similarity FROM both_ j JOIN size m ON m.id = j.a JOIN size o ON o.id = j.b WHERE j.i / (m.n + o.n - j.i)::DOUBLE >= 0.5
"""


def _sets(spark, sf_dir):
    return S.token_sets(Catalog(spark, sf_dir).table("documents"), "doc_id", "text")


def _classes(spark, sf_dir):
    return S.classes(Catalog(spark, sf_dir).table("documents"), "doc_id", "text")


def _rounded(pairs):
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("minhash_sig", f"WITH {_SIG} SELECT * FROM sig")
def minhash_sig(spark, sf_dir):
    return S.signatures(_sets(spark, sf_dir))


@query("lsh_pairs", f"WITH {_REPS}, x AS (SELECT id, {text_key_sql('token')} AS x FROM s), sig AS (SELECT id, count(*)::BIGINT AS n, {_MIN} FROM x GROUP BY id), bands AS ({_BANDS}), cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.u = y.u AND x.v = y.v AND x.id < y.id), {_JACCARD} {_MEMBERS}")
def lsh_pairs(spark, sf_dir):
    reps, members = _classes(spark, sf_dir)
    return _rounded(S.with_members(S.lsh_pairs(reps), members))


@query("jaccard_exact", f"""
    WITH {_REPS}, size AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    j AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM s x JOIN s y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2)
    SELECT j.a AS a, j.b AS b, round(j.i / (m.n + o.n - j.i)::DOUBLE, 6) AS similarity FROM j JOIN size m ON m.id = j.a JOIN size o ON o.id = j.b WHERE j.i / (m.n + o.n - j.i)::DOUBLE >= 0.5 {_MEMBERS}
""")
def jaccard_exact(spark, sf_dir):
    reps, members = _classes(spark, sf_dir)
    return _rounded(S.with_members(S.exact_pairs(reps), members))
