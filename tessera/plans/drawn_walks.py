"""SQL of the walks that are drawn for quotas: tries, which of them are accepted, and the balanced allocation."""

from __future__ import annotations

from tessera import config
from tessera.plans import fixture as X

#: CTE nd(wsi_id, label, root, node_id, place): the nodes of regions, and of slides as a whole, by their place in it.
_IN_REGIONS = """, nd AS MATERIALIZED (SELECT lab.wsi_id, lab.label, cc.root % 10000000 AS root, node_id, row_number() OVER (PARTITION BY lab.wsi_id, lab.label, cc.root ORDER BY node_id) - 1 AS place
    FROM lab JOIN cc ON cc.id = lab.wsi_id * 10000000 + lab.node_id)"""
_IN_SLIDES = ", nd AS MATERIALIZED (SELECT wsi_id, '' AS label, CAST(0 AS BIGINT) AS root, node_id, row_number() OVER (PARTITION BY wsi_id ORDER BY node_id) - 1 AS place FROM lab)"


def _drawn(seed: str, nodes: str, quotas: str, bounce: bool) -> str:
    """CTEs try and good(wsi_id, label, root, quota, attempt, path): for quotas (wsi_id, label, root, n_nodes, quota) the tries
    that are long enough, the first of each path, whichever way round."""
    draw = "CAST('0x' || substr(md5('{}:' || name), 1, 8) AS BIGINT)"
    return f"""{nodes},
named AS (SELECT *, wsi_id || ':' || label || ':' || root || ':' || attempt AS name FROM (SELECT *, unnest(range(CASE WHEN quota > 0 THEN CAST(10 * quota AS BIGINT) ELSE 0 END)) AS attempt FROM ({quotas}))),
try AS MATERIALIZED (SELECT q.wsi_id, q.label, q.root, q.quota, q.attempt, nd.node_id AS start, CAST('0x' || substr(md5(name), 1, 15) AS BIGINT) AS walk_id, {config.WALK_MIN} + {draw.format("length")} % {config.WALK_MAX - config.WALK_MIN + 1} AS length
    FROM named q JOIN nd ON nd.wsi_id = q.wsi_id AND nd.label = q.label AND nd.root = q.root AND nd.place = {draw.format(seed)} % q.n_nodes)
{X.walk_sql(bounce, bounce, tries="try")},
good AS MATERIALIZED (SELECT t.wsi_id, t.label, t.root, t.quota, min(t.attempt) AS attempt, arg_min(walk.path, t.attempt) AS path FROM walk JOIN try t ON t.wsi_id = walk.wsi_id AND t.walk_id = walk.walk_id
    WHERE len(walk.path) >= {config.WALK_MIN} GROUP BY t.wsi_id, t.label, t.root, t.quota, least(walk.path, list_reverse(walk.path)))"""


_FIRST = ", made AS MATERIALIZED (SELECT wsi_id, label, root, attempt, path FROM (SELECT *, row_number() OVER (PARTITION BY wsi_id, label, root ORDER BY attempt) AS k FROM good) WHERE k <= quota)"
_SIZES = "SELECT wsi_id, '' AS label, CAST(0 AS BIGINT) AS root, count(*) AS n_nodes, 50 AS quota FROM lab GROUP BY wsi_id HAVING count(*) >= " + str(config.WALK_MIN)
#: made(wsi_id, label, root, attempt, path): fifty walks of each slide, thirty of each region, the balanced allocation.
PER_SLIDE = X.BASE + _drawn("slide", _IN_SLIDES, _SIZES, False) + _FIRST
PER_REGION = X.BASE + X.REGIONS + _drawn("attempt", _IN_REGIONS, "SELECT wsi_id, label, root, n_nodes, 30 AS quota FROM reg", True) + _FIRST
#: A region gets most if those before it yield nothing; tries are made for that, and al says how many of them count.
BALANCED = (
    X.BASE
    + X.REGIONS
    + """, rk AS MATERIALIZED (SELECT reg.*, row_number() OVER big - 1 AS size_rank, cap.target, cap.n_nodes AS total, sum(reg.n_nodes) OVER (PARTITION BY reg.label ORDER BY reg.n_nodes DESC, wsi_id, root ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM reg JOIN cap ON cap.label = reg.label WINDOW big AS (PARTITION BY reg.label ORDER BY reg.n_nodes DESC, wsi_id, root))"""
    + _drawn("attempt", _IN_REGIONS, "SELECT wsi_id, label, root, n_nodes, greatest(1, CAST(round_even(target * n_nodes / rest, 0) AS BIGINT)) AS quota FROM rk", True)
    + """, ls AS MATERIALIZED (SELECT rk.*, coalesce(f.firsts, []) AS firsts FROM rk LEFT JOIN (SELECT wsi_id, label, root, list(attempt) AS firsts FROM good GROUP BY ALL) f ON f.wsi_id = rk.wsi_id AND f.label = rk.label AND f.root = rk.root),
al(label, size_rank, lft, nds, alloc, got) AS (SELECT label, CAST(-1 AS BIGINT), CAST(target AS BIGINT), CAST(total AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ls WHERE size_rank = 0
    UNION ALL SELECT label, size_rank, CAST(lft - got AS BIGINT), CAST(nds - n_nodes AS BIGINT), a, got FROM (SELECT *, CAST(least(a, len(list_filter(firsts, lambda x: x < greatest(10 * a, 10)))) AS BIGINT) AS got FROM (
        SELECT al.label, ls.size_rank, al.lft, al.nds, ls.n_nodes, ls.firsts, CASE WHEN al.lft <= 0 THEN CAST(0 AS BIGINT) ELSE greatest(1, CAST(round_even(al.lft * ls.n_nodes / al.nds, 0) AS BIGINT)) END AS a
        FROM al JOIN ls ON ls.label = al.label AND ls.size_rank = al.size_rank + 1))),
taken AS (SELECT ls.wsi_id, ls.label, ls.root, al.alloc, al.got FROM ls JOIN al ON al.label = ls.label AND al.size_rank = ls.size_rank),
made AS MATERIALIZED (SELECT wsi_id, label, root, attempt, path FROM (SELECT g.*, t.got, row_number() OVER (PARTITION BY g.wsi_id, g.label, g.root ORDER BY g.attempt) AS k FROM good g JOIN taken t ON t.wsi_id = g.wsi_id AND t.label = g.label AND t.root = g.root) WHERE k <= got)"""
)
REPORT = f""", prod AS (SELECT label, CAST(sum(got) AS BIGINT) AS produced FROM taken GROUP BY label)
SELECT cap.label, CAST(cap.target AS BIGINT) AS target, produced, round(produced * {(config.WALK_MIN + config.WALK_MAX) / 2} / cap.n_nodes, 6) AS redundancy,
    CASE WHEN produced >= capacity THEN 'none' WHEN target = capacity THEN 'tissue' ELSE 'ratio' END AS limited_by FROM cap JOIN prod ON prod.label = cap.label"""
#: fin: the walks made, numbered in order of region and attempt, over global_idx.
FINISHED = """, num AS MATERIALIZED (SELECT made.*, reg.component_id, reg.wsi_id || '__' || reg.label || '__' || reg.component_id AS region_key, row_number() OVER (ORDER BY made.wsi_id, made.label, reg.component_id, attempt) - 1 AS path_id
    FROM made JOIN reg ON reg.wsi_id = made.wsi_id AND reg.label = made.label AND reg.root = made.root),
fin AS MATERIALIZED (SELECT num.path_id, num.wsi_id, len(num.path) AS path_len, ids.label_id, num.label, num.component_id, num.region_key, g.path FROM num JOIN ids ON ids.label = num.label
    JOIN (SELECT s.path_id, string_agg(idx.global_idx, ',' ORDER BY s.pos) AS path FROM (SELECT path_id, wsi_id, unnest(path) AS node_id, generate_subscripts(path, 1) AS pos FROM num) s JOIN idx ON idx.wsi_id = s.wsi_id AND idx.node_id = s.node_id GROUP BY s.path_id) g ON g.path_id = num.path_id)"""
BY_WALK = """, k AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY substr(md5('42:' || path_id), 1, 8), path_id) AS k, count(*) OVER (PARTITION BY label_id) AS n FROM fin)
SELECT path_id, wsi_id, CASE WHEN k <= round_even(n * CAST(0.15000000000000005 AS DOUBLE), 0) THEN 'test' WHEN k <= round_even(n * CAST(0.30000000000000004 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split, path_len, label_id, label, component_id, region_key, path FROM k"""
BY_REGION = f""", pr AS (SELECT label, region_key, any_value(label_id) AS label_id, substr(md5('42:' || region_key), 1, 8) AS h FROM fin GROUP BY ALL),
rg AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, region_key) AS k FROM pr),
rest AS (SELECT * FROM rg WHERE k > CASE WHEN label = 'SOLIDE' THEN 2 ELSE 1 END),
fw AS (SELECT min(c) AS fewest FROM (SELECT count(*) AS c FROM rest GROUP BY label_id)),
sm AS (SELECT region_key, h, CASE WHEN fewest >= 2 THEN label_id ELSE -1 END AS s FROM rest, fw),
tv AS (SELECT region_key, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY h, region_key) <= round_even(count(*) OVER (PARTITION BY s) * CAST({0.15 / (0.70 + 0.15)!r} AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM sm)
SELECT path_id, wsi_id, coalesce(tv.split, 'test') AS split, path_len, label_id, label, component_id, fin.region_key, path FROM fin LEFT JOIN tv ON tv.region_key = fin.region_key"""
