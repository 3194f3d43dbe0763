"""SQL of the rules and of the fold, for the comparison only."""
from kinweave import settings as S


def cands(where_r1="", tag="", th=5.0):
    return f"""
c1{tag} AS (SELECT stock_code subject_code, 'E:'||CAST(entity_id AS VARCHAR) party_id, display_name party_name, 1 rule_no,
  CASE WHEN ratio IS NULL THEN 2 ELSE 3 END conf, CASE WHEN ratio>=50 THEN 95 WHEN ratio>=20 THEN 85 WHEN ratio>={th} THEN 75 ELSE 50 END score, id k1, 0 k2, '' k3,
  display_name||' -HOLDS'||CASE WHEN ratio IS NULL THEN '' ELSE ' ['||CAST(ratio AS VARCHAR)||'%]' END||'-> '||stock_code h,
  display_name||' -HOLDS'||CASE WHEN ratio IS NULL THEN '' ELSE ' ['||CAST(ratio AS VARCHAR)||'%]' END||'-> '||stock_code p
  FROM (SELECT stock_code, entity_id, max(ratio) ratio, max(id) id, max(holder_rank) rk FROM holding GROUP BY ALL) JOIN entity USING (entity_id)
  WHERE is_channel=0 AND (ratio>={th} OR (ratio IS NULL AND rk<=10))),
co AS MATERIALIZED (SELECT stock_code o_code, short_name o_name FROM company),
c2 AS (SELECT a.stock_code subject_code, 'C:'||b.stock_code party_id, coalesce(o_name,b.stock_code) party_name, 2 rule_no, 3 conf, 90 score, a.id k1, b.id k2, '' k3,
  a.stock_code||' -CONTROLLED_BY ['||CAST(a.control_ratio AS VARCHAR)||'%]-> '||display_name h,
  a.stock_code||' -CONTROLLED_BY ['||CAST(a.control_ratio AS VARCHAR)||'%]-> '||display_name||' | '||display_name||' -CONTROLS-> '||b.stock_code p
  FROM controller a JOIN entity e ON a.entity_id=e.entity_id AND is_channel=0 JOIN controller b ON a.entity_id=b.entity_id AND a.stock_code<>b.stock_code LEFT JOIN co ON o_code=b.stock_code),
large AS MATERIALIZED (SELECT stock_code, entity_id, report_period, ratio, id FROM holding WHERE ratio>=5),
c3 AS (SELECT a.stock_code subject_code, 'C:'||b.stock_code party_id, coalesce(o_name,b.stock_code) party_name, 3 rule_no, 1 conf, 30 score, a.id k1, b.id k2, '' k3,
  a.stock_code||' -HELD_BY ['||CAST(a.ratio AS VARCHAR)||'%]-> '||display_name h,
  a.stock_code||' -HELD_BY ['||CAST(a.ratio AS VARCHAR)||'%]-> '||display_name||' | '||display_name||' -HOLDS ['||CAST(b.ratio AS VARCHAR)||'%]-> '||b.stock_code p
  FROM large a JOIN entity e ON a.entity_id=e.entity_id AND is_channel=0 JOIN large b ON a.entity_id=b.entity_id AND a.report_period=b.report_period
  AND a.stock_code<>b.stock_code LEFT JOIN co ON o_code=b.stock_code),
c4 AS (SELECT a.stock_code subject_code, 'C:'||b.stock_code party_id, coalesce(o_name,b.stock_code) party_name, 4 rule_no,
  CASE confidence WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END conf, 70 score, a.id k1, b.id k2, '' k3,
  a.stock_code||' -SERVED_BY ['||a.title||']-> '||display_name h,
  a.stock_code||' -SERVED_BY ['||a.title||']-> '||display_name||' | '||display_name||' -SERVES_AS ['||b.title||']-> '||b.stock_code p
  FROM position a JOIN entity e ON a.entity_id=e.entity_id AND is_channel=0 JOIN position b ON a.entity_id=b.entity_id AND a.stock_code<>b.stock_code
  LEFT JOIN co ON o_code=b.stock_code WHERE a.title_class IN ('director','supervisor','senior_mgmt')),
c5 AS (SELECT a.stock_code subject_code, 'C:'||b.stock_code party_id, coalesce(o_name,b.stock_code) party_name, 5 rule_no, 3 conf, 80 score, a.id k1, b.id k2, '' k3,
  a.stock_code||' -SERVED_BY ['||a.title||']-> '||display_name h,
  a.stock_code||' -SERVED_BY ['||a.title||']-> '||display_name||' | '||display_name||' -HOLDS ['||CAST(b.ratio AS VARCHAR)||'%]-> '||b.stock_code p
  FROM position a JOIN entity e ON a.entity_id=e.entity_id JOIN holding b ON a.entity_id=b.entity_id AND a.stock_code<>b.stock_code AND b.ratio>=5
  LEFT JOIN co ON o_code=b.stock_code WHERE a.title_class IN ('director','supervisor','senior_mgmt')),
{chain('chain', 'holding', 5)},
c6 AS (SELECT target subject_code, 'E:'||CAST(holder AS VARCHAR) party_id, display_name party_name, 6 rule_no, 3 conf, 75 score, ids[1] k1, ids[len(ids)] k2,
  array_to_string(ids,'>') k3, display_name||' -HOLDS*'||CAST(hops AS VARCHAR)||'-> '||target h, display_name||' -HOLDS*'||CAST(hops AS VARCHAR)||'-> '||target p
  FROM chain JOIN entity ON entity_id=holder WHERE hops>=2),
c7 AS (SELECT s subject_code, 'C:'||o party_id, o party_name, 7 rule_no, 3 conf, 70 score, id k1, 0 k2, '' k3, '' h, '' p FROM
  (SELECT subject_code s, counterparty_code o, id FROM guarantee_pair UNION ALL SELECT counterparty_code, subject_code, id FROM guarantee_pair) WHERE s<>o)"""


def chain(name, holding, min_ratio):
    """Chains by three plain joins, without pruning by single edges."""
    return f"""
{name}_e AS (SELECT entity_id, stock_code, ratio, id FROM {holding} WHERE ratio IS NOT NULL AND ratio>={min_ratio}),
{name}_up AS (SELECT * FROM {name}_e WHERE entity_id NOT IN (SELECT entity_id FROM entity WHERE is_channel=1)),
{name}_l AS (SELECT entity_id, min(stock_code) via FROM entity JOIN company ON display_name=short_name GROUP BY 1),
{name}1 AS (SELECT stock_code target, entity_id holder, ratio prod, 1 hops, [id] ids FROM {name}_e),
{name}2 AS (SELECT target, u.entity_id holder, prod*(u.ratio/100.0) prod, 2 hops, list_append(ids,u.id) ids FROM {name}1 JOIN {name}_l l ON l.entity_id=holder JOIN {name}_up u ON u.stock_code=via WHERE prod*(u.ratio/100.0)>={min_ratio}),
{name}3 AS (SELECT target, u.entity_id holder, prod*(u.ratio/100.0) prod, 3 hops, list_append(ids,u.id) ids FROM {name}2 JOIN {name}_l l ON l.entity_id=holder JOIN {name}_up u ON u.stock_code=via WHERE prod*(u.ratio/100.0)>={min_ratio}),
{name} AS (SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2 UNION ALL SELECT * FROM {name}3)"""


UNION = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, 8))


def fold(source, keys="subject_code, party_id"):
    return f"""
(SELECT {keys}, s.name party_name, s.conf conf, s.score score_c, rule_id, n n_candidates,
  CASE WHEN n=1 THEN p1 ELSE array_to_string([x for x in [h1, h2] if x<>''], ' | ') END path FROM (
 SELECT {keys}, list_reduce(list(struct_pack(conf:=conf, score:=score, name:=party_name) ORDER BY rule_no, -conf, k1, k2, k3),
   lambda a, x: struct_pack(conf:=greatest(a.conf,x.conf), score:=CAST(least(100, CASE WHEN x.conf>a.conf THEN greatest(a.score,x.score) ELSE a.score END+10) AS INTEGER),
    name:=CASE WHEN x.conf>a.conf THEN x.name ELSE a.name END)) s,
  array_to_string([y for y in list_sort(list_distinct(list('R'||CAST(rule_no AS VARCHAR))))], '+') rule_id, count(*) n,
  arg_min(p, (rule_no, -conf, k1, k2, k3)) p1, arg_min(h, (rule_no, -conf, k1, k2, k3)) h1, arg_max(h, (rule_no, -conf, k1, k2, k3)) h2 FROM ({source}) GROUP BY {keys}))"""


def parties(th=5.0):
    """CTE text giving `cand` and `parties` (conf as text)."""
    return cands(th=th).strip() + f""",
cand AS ({UNION}),
parties AS (SELECT subject_code, party_id, party_name, rule_id, CASE conf WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END confidence,
  score_c, n_candidates, path FROM {fold('SELECT * FROM cand')})"""


CTES = parties()
RULE_NAMES = list(S.RULES)
