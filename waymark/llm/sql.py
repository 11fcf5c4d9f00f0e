"""DuckDB SQL that says what four of the queries return; the other methods are beyond SQL."""

from __future__ import annotations

from waymark.llm.embedding_dedup import EmbeddingParams
from waymark.llm.suffix_dedup import SuffixParams
from waymark.llm.url_filter import UrlParams


def url_filter(p: UrlParams = UrlParams()) -> str:
    """The template tree, one level of path segments after another."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(p.rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(way)})", h + way, verdict) for h, way, verdict in order]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {quoted(name)}" for c, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, _, v in fits) + " END"
    levels, seen = [], "w0"
    for k in range(p.depth):
        levels.append(f"""c{k} AS (SELECT host, template, segs[{k + 1}] AS seg, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM {seen} WHERE len(segs) > {k} GROUP BY ALL),
v{k} AS (SELECT host, template, count(*) AS kids, sum(n) AS all_n, sum(l) AS all_l, sum(b) AS all_b FROM c{k} GROUP BY ALL),
s{k} AS (SELECT c.host, c.template, seg, CASE WHEN kids >= {p.kids} AND all_n < {p.repeats}::DOUBLE * kids THEN '*'
WHEN l > 0 AND all_l > l AND abs(b::DOUBLE / nullif(l, 0) - (all_b - b)::DOUBLE / nullif(all_l - l, 0)) <= {p.z}::DOUBLE * sqrt(all_b::DOUBLE / nullif(all_l, 0) * (1 - all_b::DOUBLE / nullif(all_l, 0)) * (1 / nullif(l, 0)::DOUBLE + 1 / nullif(all_l - l, 0)::DOUBLE)) THEN '{{~}}' ELSE seg END AS name
FROM c{k} c JOIN v{k} v ON c.host = v.host AND c.template = v.template),
w{k + 1} AS (SELECT w.host, w.path, w.n, w.l, w.b, w.segs, CASE WHEN name IS NULL THEN w.template ELSE {"w.template || '/' || " if k else ""}name END AS template
FROM {seen} w LEFT JOIN s{k} s ON s.host = w.host AND s.template = w.template AND s.seg = w.segs[{k + 1}])""")
        seen = f"w{k + 1}"
    cut = f"CASE WHEN len(parts) > {p.depth} THEN list_append(parts[1:{p.depth - 1}], array_to_string(parts[{p.depth}:], '/')) ELSE parts END"
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS rule_verdict FROM r),
p AS (SELECT host, path, count(*) AS n, count(rule_verdict) AS l, count(*) FILTER (rule_verdict = 'block') AS b, string_split(path, '/') AS parts FROM j GROUP BY host, path),
w0 AS (SELECT host, path, n, l, b, {cut} AS segs, '' AS template FROM p),
{", ".join(levels)},
t AS (SELECT host, template, (sum(b) + {p.prior / 2}::DOUBLE) / (sum(l) + {p.prior}::DOUBLE) AS purity FROM {seen} GROUP BY ALL)
SELECT page_id, j.host, j.path, rule, coalesce(rule_verdict, CASE WHEN purity >= {p.purity} THEN 'block' ELSE 'allow' END) AS verdict, w.template, purity
FROM j JOIN {seen} w ON w.host = j.host AND w.path = j.path JOIN t ON t.host = w.host AND t.template = w.template"""


def suffix_dedup(p: SuffixParams = SuffixParams(), step: int = 1000) -> str:
    """Every window of every text as hexadecimal digits, cut from parts of ``step`` windows."""
    n = p.length
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
parts AS (SELECT rid, doc_id, pos, substr(h, 2 * pos + 1, {2 * (step + n - 1)}) AS part, least({step}, n_bytes - {n - 1} - pos) AS many FROM (SELECT *, unnest(range(0, greatest(n_bytes - {n - 1}, 0), {step})) AS pos FROM d)),
w AS (SELECT rid, doc_id, pos + i AS i, unhex(substr(part, CAST(2 * i + 1 AS BIGINT), {2 * n})) AS s FROM (SELECT *, unnest(range(0, many)) AS i FROM parts)),
least_ AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT rid, i FROM w JOIN least_ USING (s) WHERE doc_id > first),
marked AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {n} THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM marked),
spans AS (SELECT rid, min(i) AS a, max(i) + {n} AS b FROM numbered GROUP BY rid, k),
before AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS kept_from FROM spans),
cut AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_end, string_agg(substr(h, CAST(2 * kept_from + 1 AS BIGINT), CAST(2 * (a - kept_from) AS BIGINT)), '' ORDER BY a) AS kept FROM before JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN last_end IS NULL THEN h ELSE kept || substr(h, CAST(2 * last_end + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (rid)"""


def embedding_dedup(p: EmbeddingParams = EmbeddingParams()) -> str:
    """All pairs of rows, and the reach of each vector through its links."""
    return f"""WITH RECURSIVE v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {p.cosine}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
per AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(per.least, vec_id)) AS component_id, coalesce(vec_id = least(vec_id, coalesce(per.least, vec_id)), true) AS kept FROM embeddings LEFT JOIN per ON per.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def merkle_manifest(levels: int = 14, crown: int = 5) -> str:
    """Trees level by level: up to 3^levels rows of a source and 3^crown sources. Crc32 by its table, made by its rule."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, depth: int) -> str:
        """From {name}0 (g, pos, h) the levels {name}0 .. {name}depth with each node's siblings in {name}s0 .. and the root."""
        out = []
        for k in range(depth):
            run = "PARTITION BY g, pos // 3 ORDER BY pos ROWS BETWEEN"
            out.append(f"""{name}s{k} AS MATERIALIZED (SELECT g, pos, h, n > 1 AS goes, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS bef, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS aft FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k})),
{name}{k + 1} AS MATERIALIZED (SELECT g, pos // 3 AS pos, CASE WHEN bool_or(goes) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {name}s{k} GROUP BY ALL)""")
        return ",\n".join(out)

    def climb(name: str, depth: int, seen: str, key: str, pos: str) -> tuple[str, str]:
        out = []
        for k in range(depth):
            made = f"{seen}_{name}{k}"
            out.append(f"{made} AS MATERIALIZED (SELECT r.* REPLACE (r.proof || s.bef || s.aft AS proof, CASE WHEN s.goes THEN sha256(s.bef || r.fold || s.aft) ELSE r.fold END AS fold) FROM {seen if not k else f'{seen}_{name}{k - 1}'} r JOIN {name}s{k} s ON s.g = r.{key} AND s.pos = r.{pos} // {3**k})")
        return ",\n".join(out), f"{seen}_{name}{depth - 1}"

    first, low = climb("t", levels, "r", "g", "pos")
    second, high = climb("c", crown, low, "zero", "g")
    return f"""WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN coalesce(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1, false) THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS fold FROM documents, crc),
r AS MATERIALIZED (SELECT doc_id, leaf, fold, '' AS proof, 0 AS zero, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t0 AS (SELECT g, pos, leaf AS h FROM r),
{tree("t", levels)},
c0 AS (SELECT 0 AS g, g AS pos, h FROM t{levels}),
{tree("c", crown)},
{first},
{second}
SELECT doc_id, leaf, t.h AS subroot, c.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = c.h AS verified FROM {high} r JOIN t{levels} t ON t.g = r.g JOIN c{crown} c ON c.g = r.zero"""
