"""Independent SQL definitions (DuckDB dialect) of the relational queries.

They restate each query's semantics from scratch — window functions,
recursive CTEs, list functions — without sharing code with the Spark
operators, so agreement is evidence of correctness.  Views ``orders``,
``lineitem``, ``part``, ``customer``, ``embeddings`` are expected to exist.
"""

from __future__ import annotations

KS_SQL = "[1, 5, 10, 15, 20, 25, 30]"

RATINGS = """ratings AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, SUM(l.l_quantity) AS qty
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_partkey)"""


DICTIONARY = """dictionary AS (
  SELECT item_id, CAST(ROW_NUMBER() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_idx FROM (SELECT DISTINCT item_id FROM ratings))"""

BRANDS = [f"Brand#{i}" for i in range(1, 26)]  # fixed values: the brands of the part table


BRAND_VECTORS = """cells AS (
  SELECT r.user_id, p.p_brand AS brand, SUM(r.qty) AS qty FROM ratings r JOIN part p ON p.p_partkey = r.item_id GROUP BY ALL),
vectors AS (
  SELECT u.user_id, list(coalesce(c.qty, 0.0) ORDER BY b.brand) AS x
  FROM (SELECT DISTINCT user_id FROM cells) u CROSS JOIN (SELECT DISTINCT brand FROM cells) b
  LEFT JOIN cells c ON c.user_id = u.user_id AND c.brand = b.brand GROUP BY u.user_id)"""


def brand_columns(cell: str) -> str:
    """One column per brand, ``cell`` with the brand's literal in it."""
    return ", ".join(cell.format(f"'{b}'") + f' AS "{b}"' for b in BRANDS)


def active(src: str = "ratings", name: str = "active", scope: str | None = None) -> str:
    by = f"{scope}, user_id" if scope else "user_id"
    return f"""{name} AS (
  SELECT * FROM {src} QUALIFY COUNT(*) OVER (PARTITION BY {by}) >= 10)"""


def folded(src: str = "active", name: str = "folded", scope: str | None = None) -> str:
    # ntile gives the larger tiles first, so they are dealt from the end
    by = f"{scope}, user_id" if scope else "user_id"
    return f"""{name} AS (
  SELECT s.*, CAST(10 - NTILE(10) OVER (PARTITION BY {by} ORDER BY item_id DESC, qty DESC) AS INTEGER) AS fold
  FROM {src} s)"""


def top_share(src: str = "ratings", name: str = "top_items") -> str:
    return f"""{name}_tot AS (SELECT item_id, SUM(qty) AS total_qty FROM {src} GROUP BY item_id),
{name} AS (
  SELECT item_id, total_qty, sales_rank FROM (
    SELECT item_id, total_qty,
           CAST(ROW_NUMBER() OVER (ORDER BY total_qty DESC, item_id) - 1 AS BIGINT) AS sales_rank
    FROM {name}_tot)
  WHERE sales_rank < (SELECT FLOOR(COUNT(*) * 0.5) FROM {name}_tot))"""


def popular_recs(src: str = "folded", scope: str | None = None, n: int = 30) -> str:
    """Per (scope, fold): top-n items by quantity in the other folds, for every
    user with rows in the other folds."""
    s = f"{scope}, " if scope else ""
    on_t = f"p.{scope} = t.{scope} AND " if scope else ""
    gs = f"g.{scope}, " if scope else ""
    ts = f"t.{scope}, " if scope else ""
    return f"""train AS (
  SELECT {gs}CAST(f.range AS INTEGER) AS fold, g.item_id, SUM(g.qty) AS score
  FROM {src} g JOIN range(10) f ON g.fold <> f.range
  GROUP BY {gs}f.range, g.item_id),
top AS (
  SELECT * FROM (
    SELECT {s}fold, item_id, score,
           CAST(ROW_NUMBER() OVER (PARTITION BY {s}fold ORDER BY score DESC, item_id) - 1 AS INTEGER) AS rank
    FROM train)
  WHERE rank < {n}),
trained AS (
  SELECT DISTINCT {gs}g.user_id, CAST(f.range AS INTEGER) AS fold
  FROM {src} g JOIN range(10) f ON g.fold <> f.range),
recs AS (
  SELECT {ts}t.fold, t.user_id, p.rank, p.item_id, p.score
  FROM trained t JOIN top p ON {on_t}p.fold = t.fold)"""


def scores(src: str = "folded", recs: str = "recs", scope: str | None = None) -> str:
    s = f"{scope}, " if scope else ""
    on = lambda a, b: (f"{a}.{scope} = {b}.{scope} AND " if scope else "")
    ts = f"tn.{scope}, " if scope else ""
    return f"""hits AS (
  SELECT {s}fold, user_id, item_id, MIN(rank) AS rank FROM {recs} r
  WHERE EXISTS (SELECT 1 FROM {src} t WHERE {on('t', 'r')}t.fold = r.fold AND t.user_id = r.user_id AND t.item_id = r.item_id)
  GROUP BY {s}fold, user_id, item_id),
ks AS (SELECT UNNEST({KS_SQL}) AS k),
rn AS (SELECT {s}fold, k, SUM(CASE WHEN rank < k THEN 1 ELSE 0 END) AS n_rec FROM {recs} CROSS JOIN ks GROUP BY {s}fold, k),
hn AS (SELECT {s}fold, k, SUM(CASE WHEN rank < k THEN 1 ELSE 0 END) AS n_hits FROM hits CROSS JOIN ks GROUP BY {s}fold, k),
tn AS (SELECT {s}fold, COUNT(*) AS n_test FROM {src} GROUP BY {s}fold),
scores AS (
  SELECT {ts}CAST(tn.fold AS INTEGER) AS fold, CAST(ks.k AS INTEGER) AS k,
         CAST(COALESCE(hn.n_hits, 0) AS BIGINT) AS n_hits,
         CAST(COALESCE(rn.n_rec, 0) AS BIGINT) AS n_rec,
         CAST(tn.n_test AS BIGINT) AS n_test,
         CASE WHEN COALESCE(rn.n_rec, 0) = 0 THEN NULL
              ELSE CAST(COALESCE(hn.n_hits, 0) AS DOUBLE) / rn.n_rec END AS precision,
         CASE WHEN tn.n_test = 0 THEN NULL
              ELSE CAST(COALESCE(hn.n_hits, 0) AS DOUBLE) / tn.n_test END AS recall
  FROM tn CROSS JOIN ks
  LEFT JOIN rn ON {on('rn', 'tn')}rn.fold = tn.fold AND rn.k = ks.k
  LEFT JOIN hn ON {on('hn', 'tn')}hn.fold = tn.fold AND hn.k = ks.k)"""


def summary(scope: str | None = None) -> str:
    s = f"{scope}, " if scope else ""
    return f"""means AS (
  SELECT {s}k, COUNT(*) AS n_folds,
         CASE WHEN COUNT(precision) = COUNT(*) THEN AVG(precision) END AS mp,
         CASE WHEN COUNT(recall) = COUNT(*) THEN AVG(recall) END AS mr
  FROM scores GROUP BY {s}k)
SELECT {s}k, CAST(n_folds AS BIGINT) AS n_folds, ROUND(mp, 6) AS mean_precision, ROUND(mr, 6) AS mean_recall,
       ROUND(CASE WHEN mp + mr = 0 THEN NULL ELSE 2.0 * mp * mr / (mp + mr) END, 6) AS f1
FROM means"""


def jvm_hash(expr: str) -> str:
    """String.hashCode of an ASCII/BMP string column."""
    h = (
        f"list_reduce(list_transform(string_split({expr}, ''), lambda ch: CAST(unicode(ch) AS BIGINT)), "
        f"lambda acc, x: (acc * 31 + x) % 4294967296, CAST(0 AS BIGINT))"
    )
    return f"CAST(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END AS INTEGER)"


# Baskets as sorted distinct lists of a part attribute per order.
def baskets(attribute: str = "p_type") -> str:
    return f"""bpairs AS (
  SELECT DISTINCT l.l_orderkey AS basket_id, p.{attribute} AS item
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
nb AS (SELECT CAST(COUNT(DISTINCT basket_id) AS DOUBLE) AS n FROM bpairs),
sub(basket_id, items, last) AS (
  SELECT basket_id, [item], item FROM bpairs
  UNION ALL
  SELECT s.basket_id, list_append(s.items, p.item), p.item
  FROM sub s JOIN bpairs p ON p.basket_id = s.basket_id AND p.item > s.last),
freq AS (
  SELECT items, COUNT(*) AS freq FROM sub GROUP BY items
  HAVING COUNT(*) >= (SELECT CEIL(CAST(1 AS DOUBLE) / 1000.0 * n) FROM nb)),
cand AS (
  SELECT items, freq, UNNEST(items) AS cons FROM freq WHERE len(items) >= 2),
rules AS (
  SELECT list_filter(c.items, lambda x: x <> c.cons) AS antecedent, c.cons AS consequent, c.freq,
         CAST(c.freq AS DOUBLE) / a.freq AS confidence
  FROM cand c JOIN freq a ON a.items = list_filter(c.items, lambda x: x <> c.cons)
  WHERE CAST(c.freq AS DOUBLE) / a.freq >= 0.2)"""


SWEEP = """levels AS (SELECT CAST(range AS INTEGER) AS i FROM range(1, 201)),
swept_items AS (
  SELECT CAST(lv.i AS DOUBLE) / 1000.0 AS support, f.items, f.freq
  FROM freq f JOIN levels lv ON CEIL(CAST(lv.i AS DOUBLE) / 1000.0 * (SELECT n FROM nb)) <= f.freq),
swept_rules AS (
  SELECT CAST(lv.i AS DOUBLE) / 1000.0 AS support, r.*
  FROM rules r JOIN levels lv ON CEIL(CAST(lv.i AS DOUBLE) / 1000.0 * (SELECT n FROM nb)) <= r.freq)"""


def centroids() -> str:
    return """emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
coords AS (
  SELECT label, pos, AVG(v) AS m FROM (
    SELECT label, UNNEST(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM emb)
  GROUP BY label, pos),
cent AS (SELECT label, list(m ORDER BY pos) AS c FROM coords GROUP BY label)"""
