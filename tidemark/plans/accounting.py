"""Fact pivots and accounting measures. A customer's year is a filing; its concepts are sums of orders by priority and status."""

from pyspark.sql import functions as F

from tidemark.functions import accounting as A
from tidemark.operators import facts
from tidemark.plans.registry import Registry, n, r6

R = Registry()

#: Concept: the priority and status whose orders make it up.
CONCEPTS = {
    "assets": None, "revenue": ("%", "F"), "net_income": ("%", "O"), "assets_current": ("1%", "%"), "cash": ("2%", "%"), "liabilities": ("3%", "%"), "liabilities_current": ("4%", "%"),
    "receivables": ("5%", "%"), "inventory": ("1%", "F"), "ppe": ("2%", "F"), "st_debt": ("3%", "F"), "lt_debt": ("4%", "F"), "st_inv": ("5%", "F"), "lt_inv": ("1%", "O"),
    "preferred": ("2%", "O"), "issue_stock": ("3%", "O"), "issue_debt": ("4%", "O"),
}
#: Concepts of the second set of ratios, taken for others.
AS = {"cfo": "cash", "capex": "ppe", "sbc": "preferred", "goodwill": "lt_inv", "retained": "liabilities", "tax": "st_debt", "pretax": "net_income", "allowance": "st_inv", "dda": "inventory", "gross_profit": "receivables", "cff": "lt_debt", "buyback": "issue_stock", "d_ar": "receivables", "op_income": "revenue", "eps": "preferred", "wavg_shares": "issue_debt"}


def _panel(t):
    def amount(of):
        if of is None:
            return F.sum("o_totalprice")
        return F.sum(F.when(F.col("o_orderpriority").like(of[0]) & F.col("o_orderstatus").like(of[1]), F.col("o_totalprice")))

    g = t.orders.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y"))
    wide = g.agg(*[F.round(amount(of), 2).alias(c) for c, of in CONCEPTS.items()]).withColumn("capital", A.capital())
    return facts.with_prior(wide, "k", "y", [*CONCEPTS, "capital"])


def _case(of):
    return "sum(o_totalprice)" if of is None else f"sum(CASE WHEN o_orderpriority LIKE '{of[0]}' AND o_orderstatus LIKE '{of[1]}' THEN o_totalprice END)"


_PANEL = f"""WITH f AS (SELECT o_custkey AS k, year(o_orderdate)::BIGINT AS y, {", ".join(f"round({_case(of)}, 2) AS {c}" for c, of in CONCEPTS.items())} FROM orders GROUP BY 1, 2),
x AS (SELECT a.*, {", ".join(f"b.{c} AS p_{c}" for c in CONCEPTS)} FROM f a JOIN f b ON b.k = a.k AND b.y = a.y - 1)"""


def _z(c):
    return f"coalesce({c}, 0)"


def _cap(p):
    z = lambda c: _z(p + c)
    wc = f"({z('assets_current')} - {z('cash')}) - ({z('liabilities_current')} - {z('st_debt')})"
    nco = f"({z('assets')} - {z('assets_current')} - {z('lt_inv')}) - ({z('liabilities')} - {z('liabilities_current')} - {z('lt_debt')})"
    fin = f"({z('st_inv')} + {z('lt_inv')}) - ({z('lt_debt')} + {z('st_debt')} + {z('preferred')})"
    return f"({wc} + {nco} + {fin})"


_FS = f"""{_PANEL}, v AS (SELECT k, y, ({_cap("")} - {_cap("p_")}) / ((assets + p_assets) / 2) AS rsst_acc, ({_z("receivables")} - {_z("p_receivables")}) / ((assets + p_assets) / 2) AS ch_rec,
    ({_z("inventory")} - {_z("p_inventory")}) / ((assets + p_assets) / 2) AS ch_inv, (assets - {_z("ppe")} - {_z("cash")}) / assets AS soft_assets,
    CASE WHEN p_revenue = 0 THEN 0 ELSE (revenue - ({_z("receivables")} - {_z("p_receivables")}) - p_revenue) / abs(p_revenue) END AS ch_cs, net_income / ((assets + p_assets) / 2) - p_net_income / p_assets AS ch_roa,
    ({_z("issue_stock")} > 0 OR {_z("issue_debt")} > 0)::INT::DOUBLE AS issue FROM x WHERE assets <> 0 AND p_assets <> 0 AND revenue IS NOT NULL AND p_revenue IS NOT NULL AND net_income IS NOT NULL AND p_net_income IS NOT NULL),
w AS (SELECT * FROM v WHERE greatest(abs(rsst_acc), abs(ch_rec), abs(ch_inv), abs(soft_assets), abs(ch_cs), abs(ch_roa)) <= 50)"""
_LIN = "+".join([f"({A.COEF['const']})"] + [f"({v}) * {k}" for k, v in A.COEF.items() if k != "const"])


@R.query("fscore_vars", f"{_FS} SELECT k, y, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in A.COEF if c != 'const')} FROM w")
def fscore_vars(t):
    return A.with_fscore(_panel(t)).where("issue is not null").select("k", "y", *[r6(c).alias(c) for c in A.COEF if c != "const"])


@R.query("logistic_score", f"{_FS} SELECT k, y, round(1 / (1 + exp(-({_LIN}))) / 0.0037, 6) AS fscore FROM w")
def logistic_score(t):
    return A.with_fscore(_panel(t)).where("issue is not null").select("k", "y", r6("fscore").alias("fscore"))


def _sr(a, b):
    return f"(CASE WHEN abs({b}) >= 1e-6 AND abs(({a}) / ({b})) <= 50 THEN ({a}) / ({b}) END)"


_AR, _APR = "nullif(abs(revenue), 0)", "nullif(abs(p_revenue), 0)"
_RATIOS = {
    "log_assets": "log10(greatest(assets, 1.0))",
    "leverage": _sr(f"{_z('st_debt')} + {_z('lt_debt')}", "assets"),
    "cash_ratio": _sr(_z("cash"), "assets"),
    "asset_growth": _sr("assets - p_assets", "p_assets"),
    "rev_growth": _sr(f"revenue - {_z('p_revenue')}", _APR),
    "net_margin": _sr("net_income", _AR),
    "roa": _sr("net_income", "assets"),
    "accruals_ta": _sr(f"net_income - ({_z('cash')} - {_z('p_cash')})", "assets"),
    "wc_ta": _sr(f"{_z('assets_current')} - {_z('liabilities_current')}", "assets"),
    "rec_rev": _sr(_z("receivables"), _AR),
    "inv_rev": _sr(_z("inventory"), _AR),
    "ppe_ta": _sr(_z("ppe"), "assets"),
    "loss": "(net_income < 0)::INT::DOUBLE",
    "neg_equity": f"(assets - {_z('liabilities')} < 0)::INT::DOUBLE",
    "dsri": _sr(_sr(_z("receivables"), _AR), f"nullif({_sr(_z('p_receivables'), _APR)}, 0)"),
    "gmi": _sr(_sr(f"{_z('p_revenue')} - {_z('p_inventory')}", _APR), f"nullif({_sr('revenue - ' + _z('inventory'), _AR)}, 0)"),
    "aqi": _sr(_sr(f"assets - {_z('assets_current')} - {_z('ppe')}", "assets"), f"nullif({_sr('p_assets - ' + _z('p_assets_current') + ' - ' + _z('p_ppe'), 'p_assets')}, 0)"),
    "sgi": _sr("revenue", _APR),
    "depi": _sr(_sr(_z("p_ppe"), "p_assets"), f"nullif({_sr(_z('ppe'), 'assets')}, 0)"),
    "lvgi": _sr(_sr(_z("liabilities"), "assets"), f"nullif({_sr(_z('p_liabilities'), 'p_assets')}, 0)"),
}


@R.query("beneish_ratios", f"{_PANEL} SELECT k, y, {', '.join(f'round({v}, 5) + 0 AS {c}' for c, v in _RATIOS.items())} FROM x WHERE assets <> 0 AND p_assets <> 0 AND revenue IS NOT NULL AND net_income IS NOT NULL")
def beneish_ratios(t):
    x = _panel(t).where("assets <> 0 and p_assets <> 0 and revenue is not null and net_income is not null")
    return A.with_ratios(x).select("k", "y", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in A.RATIOS])


_NAMED = {"cfo_ta": ("cfo", "assets"), "capex_ta": ("capex", "assets"), "sbc_rev": ("sbc", "revenue"), "goodwill_ta": ("goodwill", "assets"), "retained_ta": ("retained", "assets"), "tax_rate": ("tax", "pretax"), "allowance": ("allowance", "receivables"), "dda_ppe": ("dda", "ppe"), "gross_margin": ("gross_profit", "revenue"), "cff_ta": ("cff", "assets"), "buyback_ta": ("buyback", "assets"), "d_ar_rev": ("d_ar", "revenue"), "accrual_ta": ("net_income - cash", "assets"), "op_accrual_ta": ("revenue - cash", "assets"), "eps_gap": ("preferred * issue_debt - net_income", "net_income")}


@R.query("named_ratios", f"{_PANEL} SELECT k, y, {', '.join(f'round(({AS.get(a, a)}) / nullif(abs({AS.get(b, b)}), 0), 4) + 0 AS {c}' for c, (a, b) in _NAMED.items())} FROM x")
def named_ratios(t):
    x = _panel(t).withColumns({k: F.col(v) for k, v in AS.items()})
    return x.select("k", "y", *[(F.round(v, 4) + F.lit(0.0)).alias(c) for c, v in A.named_ratios().items()])


_SL = "sign({0}) * log10(1 + abs({0}))"


@R.query("raw_items_block", f"{_PANEL} SELECT k, y, {', '.join(f'round({_SL.format(p + c)}, 6) AS {c}_{s}' for p, s in (('', 'cur'), ('p_', 'pri')) for c in CONCEPTS)}, {', '.join('round(' + _SL.format(f'({c} - p_{c})') + f', 6) + 0 AS {c}_chg' for c in CONCEPTS)} FROM x")
def raw_items_block(t):
    return _panel(t).select("k", "y", *[r6(v).alias(c) for c, v in A.raw_items(list(CONCEPTS)).items()])


_Q = "SELECT o_custkey AS k, year(o_orderdate)::BIGINT AS y, sum(o_totalprice) AS v, " + ", ".join(f"sum(CASE WHEN quarter(o_orderdate) = {i} THEN o_totalprice ELSE 0 END) AS q{i}" for i in (1, 2, 3)) + " FROM orders GROUP BY 1, 2"


@R.query("implied_q4", f"SELECT k, y, round(v - (q1 + q2 + q3), 2) + 0 AS q4, round((v - (q1 + q2 + q3)) / v, 6) + 0 AS share FROM ({_Q})")
def implied_q4(t):
    q = lambda i: F.sum(F.when(F.quarter("o_orderdate") == i, F.col("o_totalprice")).otherwise(0.0)).alias(f"q{i}")
    x = t.orders.groupBy(F.col("o_custkey").alias("k"), n(F.year("o_orderdate")).alias("y")).agg(F.sum("o_totalprice").alias("v"), q(1), q(2), q(3))
    q4, share = A.fourth_quarter(F.col("v"), [F.col("q1"), F.col("q2"), F.col("q3")])
    return x.select("k", "y", (F.round(q4, 2) + F.lit(0.0)).alias("q4"), r6(share).alias("share"))


@R.query("capped_share", f"{_PANEL} SELECT k, y, round(CASE WHEN receivables - assets_current IS NOT NULL AND cash <> 0 THEN greatest(-2, least(2, (receivables - assets_current) / abs(cash))) END, 6) AS s FROM x")
def capped_share(t):
    return _panel(t).select("k", "y", r6(A.capped_share(F.col("receivables") - F.col("assets_current"), F.col("cash"))).alias("s"))


QUERIES, ORACLE_SQL = R.queries, R.sql
