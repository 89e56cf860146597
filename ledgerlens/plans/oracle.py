"""SQL (DuckDB dialect) that gives every registered result by another route.

The statements are written from the definitions of the results, over four
shared tables: customers, products, quarters of revenue, and quarters of
product margins. Ranks and percent ranks are counted (rows that are strictly
better, values that are strictly smaller) rather than taken from rank
windows, and periods are joined by number. So they check the Spark plans
without sharing their shape.

Types are pinned with explicit casts on both sides: ids and counts BIGINT,
calendar keys and scores INTEGER, money sums DECIMAL(38,4), ratios computed in
DOUBLE and cast to the stated decimal.
"""

from __future__ import annotations

from ledgerlens.params import HIGH_PROFIT_LABEL, LOW_PROFIT_LABEL, OTHER_LABEL, SEGMENT_DEFAULT, STANDIN_PARAMS, Params

#: The stand-in tables over the raw test tables.
VIEWS: dict[str, str] = {
    "soh": """select o_orderkey as SalesOrderID, concat('SO', o_orderkey) as SalesOrderNumber, o_custkey as CustomerID,
    case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_orderkey % 17 end as SalesPersonID,
    (o_orderkey % 5 <> 0)::integer as OnlineOrderFlag, c_nationkey as TerritoryID,
    o_orderdate as OrderDate, o_orderstatus as Status, o_totalprice::decimal(15,4) as SubTotal
  from orders left join customer on c_custkey = o_custkey""",
    "sod": """select l_orderkey as SalesOrderID, l_partkey as ProductID, l_quantity::integer as OrderQty,
    (l_extendedprice::decimal(12,2) * (1.00 - l_discount::decimal(3,2)))::decimal(15,4) as LineTotal
  from lineitem""",
    "cust": """select c_custkey as CustomerID,
    case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_custkey end as StoreID from customer""",
    "terr": "select n_nationkey as TerritoryID, n_name as Name from nation",
    "prod": """select p_partkey as ProductID, p_name as Name,
    (p_retailprice::decimal(8,2) * 1.85)::decimal(12,4) as StandardCost from part""",
    "poh": """select concat(l_orderkey, '-', l_suppkey) as PurchaseOrderID, l_suppkey as VendorID, any_value(o_orderstatus) as Status
  from lineitem, orders where o_orderkey = l_orderkey group by l_orderkey, l_suppkey""",
    "pod": """select concat(l_orderkey, '-', l_suppkey) as PurchaseOrderID, l_partkey as ProductID, l_quantity::integer as OrderQty,
    if(l_returnflag = 'R', l_quantity::integer, 0) as RejectedQty from lineitem""",
    "vend": "select s_suppkey as BusinessEntityID, s_name as Name from supplier",
    "wo": "select if(l_returnflag = 'R', l_linenumber - 1, null) as ScrapReasonID, l_quantity::integer as ScrappedQty from lineitem",
    "sr": "select r_regionkey as ScrapReasonID, r_name as Name from region",
}


def _value(v: object) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def _percent(part: str, whole: str, kind: str) -> str:
    return f"(({part})::double * 100.0 / nullif(({whole})::double, 0))::decimal({kind})"


def _starts(name: str, prefixes: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"starts_with({name}, '{x}')" for x in prefixes) + ")"


def _line(name: str, p: Params) -> str:
    whens = " ".join(f"when starts_with({name}, '{x}') then '{x}'" for x in p.product_lines)
    return f"case {whens} else '{OTHER_LABEL}' end"


def _tables(p: Params) -> dict[str, tuple[tuple[str, ...], str]]:
    """Shared tables: what each reads, and its query."""
    group = (
        f"case when {_starts('Name', p.high_prefixes)} then '{HIGH_PROFIT_LABEL}' "
        f"when {_starts('Name', p.low_prefixes)} then '{LOW_PROFIT_LABEL}' else '{OTHER_LABEL}' end"
    )
    rules = " ".join(f"when RFM like '{pattern}' then '{label}'" for label, pattern in p.segment_rules)

    def share_below(measure: str) -> str:
        # Share of the other customers whose value is strictly smaller.
        return (
            f"select {measure} as v, (coalesce(sum(count(*)) over (order by {measure} rows between unbounded preceding and 1 preceding), 0))"
            f"::double / nullif((select count(*) from customers) - 1, 0)::double as below from customers group by {measure}"
        )

    def tier(below: str) -> str:
        return f"(1 + (coalesce({below}, 0) > 0.25)::integer + (coalesce({below}, 0) > 0.5)::integer + (coalesce({below}, 0) > 0.75)::integer)"

    return {
        "customers": (
            ("soh",),
            f"""select CustomerID, sum(SubTotal)::decimal(38,4) as TotalRev, count(distinct SalesOrderNumber) as TotalOrder,
    (date '{p.as_of}' - max(OrderDate)::date)::integer as GapDay
  from soh group by CustomerID""",
        ),
        "below_rev": (("customers",), share_below("TotalRev")),
        "below_order": (("customers",), share_below("TotalOrder")),
        "below_gap": (("customers",), share_below("GapDay")),
        "scores": (
            ("customers", "below_rev", "below_order", "below_gap"),
            f"""select CustomerID, TotalRev, {tier('r.below')} as Monetary,
    if(CustomerID is null, null, TotalOrder) as TotalOrder, if(CustomerID is null, null, {tier('o.below')}) as Frequency,
    if(CustomerID is null, null, GapDay) as GapDay, if(CustomerID is null, null, 5 - {tier('g.below')}) as Recency
  from customers, below_rev r, below_order o, below_gap g where TotalRev = r.v and TotalOrder = o.v and GapDay = g.v""",
        ),
        "segmented": (
            ("scores",),
            f"""select *, case {rules} else '{SEGMENT_DEFAULT}' end as Cus_Category
  from (select *, concat(Recency, Frequency, Monetary) as RFM from scores)""",
        ),
        "segments": (
            ("segmented",),
            """select Cus_Category, count(*) as NumCustomer, sum(TotalRev)::decimal(38,4) as TotalRevenue from segmented group by all""",
        ),
        "products": (
            ("sod", "prod"),
            """select ProductID, Name, (any_value(Sold))::decimal(38,4) as Revenue,
    (any_value(Sold) - any_value(Quantity) * any_value(StandardCost))::decimal(38,4) as Profit
  from (select ProductID, sum(LineTotal) as Sold, sum(OrderQty) as Quantity from sod group by ProductID) join prod using (ProductID)
  group by ProductID, Name""",
        ),
        "best": (("products",), f"select * from products order by Profit desc, ProductID limit {p.top_products}"),
        "losses": (
            ("products",),
            f"""select ProductID, Name as ProductName, Revenue, Profit,
    coalesce({_percent('Profit', 'Revenue', '19,6')}, 0::decimal(19,6)) as ProfitMarginPct from products where Profit < 0""",
        ),
        "revenue": (
            ("soh",),
            """select *, row_number() over (order by y, q) as nth
  from (select year(OrderDate)::integer as y, quarter(OrderDate)::integer as q, sum(SubTotal)::decimal(38,4) as total from soh group by y, q)""",
        ),
        "growth": (
            ("revenue",),
            f"""select now.y as OrderYear, now.q as OrderQuarter, now.total as TotalQuarterlyRevenue, ago.total as PreviousQuarterRevenue,
    (now.total - ago.total)::decimal(38,4) as RevenueChange, {_percent('now.total - ago.total', 'ago.total', '19,4')} as RevenueGrowthPercent
  from revenue now left join revenue ago on ago.nth = now.nth - 1""",
        ),
        "margins": (
            ("soh", "sod", "prod"),
            f"""select year(OrderDate)::integer as y, quarter(OrderDate)::integer as q, {group} as kind,
    sum(LineTotal)::decimal(38,4) as revenue, sum(OrderQty * StandardCost)::decimal(38,4) as cost
  from sod join prod using (ProductID) join soh using (SalesOrderID) group by all""",
        ),
        "quarters": (
            ("margins",),
            """select y, q, sum(revenue)::decimal(38,4) as revenue, sum(cost)::decimal(38,4) as cost,
    (sum(revenue) - sum(cost))::decimal(38,4) as profit from margins group by y, q""",
        ),
        "groups": (
            ("margins",),
            f"""select y as OrderYear, q as OrderQuarter, kind as ProductType, revenue as TotalRevenue, cost as TotalCost,
    (revenue - cost)::decimal(38,4) as TotalProfit, {_percent('revenue - cost', 'revenue', '8,2')} as ProfitRate
  from margins where kind <> '{OTHER_LABEL}'""",
        ),
        "channels": (
            ("soh",),
            """select if(flag = 1, 'Online', 'Offline') as SalesChannel, TotalOrders, TotalRevenue
  from (select OnlineOrderFlag as flag, count(distinct SalesOrderID) as TotalOrders, sum(SubTotal)::decimal(38,4) as TotalRevenue
    from soh group by OnlineOrderFlag)""",
        ),
        "bought": (
            ("poh", "pod"),
            f"""select VendorID, ProductID, sum(OrderQty)::bigint as n, sum(RejectedQty)::bigint as bad
  from pod join poh using (PurchaseOrderID) where Status = {_value(p.completed_po_status)} group by all""",
        ),
        "vendors": (
            ("bought", "vend"),
            f"""select VendorID, any_value(Name) as Name, sum(n)::bigint as TotalOrder, sum(bad)::bigint as TotalReject,
    {_percent('sum(bad)', 'sum(n)', '5,2')} as RejectedRate
  from bought join vend on BusinessEntityID = VendorID group by VendorID""",
        ),
        "vendor_products": (
            ("bought", "vend"),
            f"""select VendorID, Name, ProductID, n as TotalOrder, bad as TotalReject, {_percent('bad', 'n', '5,2')} as RejectedRate
  from bought join vend on BusinessEntityID = VendorID where n > {p.vendor_product_min_qty}""",
        ),
    }


def _runs(source: str, extra: str = "") -> str:
    """The longest run of numbers ``nth`` that follow one another in ``source``, with the ends' other columns."""
    firsts = f"select * from {source} a where not exists (from {source} b where b.nth = a.nth - 1)"
    lasts = f"select * from {source} a where not exists (from {source} b where b.nth = a.nth + 1)"
    return f"""select (l.nth - f.nth + 1)::bigint as RunQuarters, f.y as FirstOrderYear, f.q as FirstOrderQuarter{extra.replace('@', 'f.').replace('%', 'First')},
    l.y as LastOrderYear, l.q as LastOrderQuarter{extra.replace('@', 'l.').replace('%', 'Last')}
  from ({firsts}) f join ({lasts}) l on l.nth = (select min(nth) from ({lasts}) where nth >= f.nth)
  order by RunQuarters desc, f.nth limit 1"""


def _results(p: Params) -> dict[str, tuple[tuple[str, ...], str]]:
    def check(person: str, store: str) -> str:
        return f"""select count(SalesOrderID) as OrderCount from soh
  where SalesPersonID is {person} and exists (from cust where cust.CustomerID = soh.CustomerID and StoreID is {store})"""

    def shares(kind: str, table: str) -> str:
        return f"(select sum({kind}) from {table})"

    members = " union all ".join(f"select '{name}' as SegmentSet, '{m}' as Cus_Category" for name, ms in p.segment_sets for m in ms)
    first, last = (f"{y * 4 + q}" for y, q in (p.margin_from, p.margin_to))
    extreme = "select '{0}' as Extreme, y as OrderYear, q as OrderQuarter, {1} as ProfitRate from quarters where revenue <> 0 order by profit::double / revenue::double {2}, y, q limit 1"
    rate = _percent("profit", "revenue", "8,2")
    return {
        "chk_offline_nonstore": (("soh", "cust"), check("not null", "null")),
        "chk_online_store": (("soh", "cust"), check("null", "not null")),
        "q1_quarterly_growth": (("growth",), "select * from growth"),
        "q2_territory_rank": (
            ("soh", "terr"),
            f"""with t as (select Name as TerritoryName, sum(SubTotal)::decimal(38,4) as TotalTerritoryRevenue
    from terr join soh using (TerritoryID) where Status = {_value(p.completed_order_status)} group by Name)
select t.*, (1 + (select count(*) from t better where better.TotalTerritoryRevenue > t.TotalTerritoryRevenue))::integer as RevenueRank from t""",
        ),
        "q3_channel_share": (
            ("soh",),
            f"""with t as (select if(SalesPersonID is null, 'Online', 'Offline') as Category, sum(SubTotal)::decimal(38,4) as SalesTotal,
    count(SalesOrderID) as OrderCount from soh group by all)
select t.*, {_percent('SalesTotal', shares('SalesTotal', 't'), '10,4')} as SalesRate, {_percent('OrderCount', shares('OrderCount', 't'), '10,4')} as OrderRate from t""",
        ),
        "q4_top5_customers": (
            ("soh",),
            f"""with t as (select if(SalesPersonID is null, 'Person', 'Store') as CustomerType, CustomerID, sum(SubTotal)::decimal(38,4) as TotalSales
    from soh group by all),
  places as (select CustomerType, TotalSales, row_number() over (partition by CustomerType order by TotalSales desc)::integer as SalesRank
    from (select distinct CustomerType, TotalSales from t)),
  sums as (select CustomerType, sum(TotalSales) as s from t group by CustomerType)
select CustomerType, CustomerID, TotalSales, SalesRank, {_percent('TotalSales', 's', '10,4')} as SalesRatePct
  from t join places using (CustomerType, TotalSales) join sums using (CustomerType) where SalesRank <= {p.top_customers}""",
        ),
        "q5_top10_profit": (
            ("products", "best"),
            f"""select ProductID, Name as ProductName, Profit as TotalProfit, {_percent('Profit', shares('Profit', 'products'), '20,4')} as ProfitRatePct from best""",
        ),
        "q6a_vendor_reject": (("vendors",), "select * from vendors"),
        "q6b_vendor_product_reject": (("vendor_products",), "select * from vendor_products"),
        "q7_high_revenue_loss": (
            ("products", "losses"),
            "select * from losses where Revenue * (select count(*) from products) > (select sum(Revenue) from products)",
        ),
        "q8_line_margin_by_quarter": (("groups",), "select * from groups"),
        "scrap_reasons": (
            ("wo", "sr"),
            """select (select sum(ScrappedQty) from wo where wo.ScrapReasonID = sr.ScrapReasonID)::bigint as TotalScrappedQty, ScrapReasonID, Name
  from sr where ScrapReasonID in (select ScrapReasonID from wo)""",
        ),
        "kpi1_quarterly_margin": (
            ("quarters",),
            f"select y as OrderYear, q as OrderQuarter, revenue as TotalRevenue, cost as TotalCost, profit as Profit, {rate} as ProfitRate from quarters",
        ),
        "kpi2_aov_by_channel": (
            ("channels",),
            "select *, (TotalRevenue::double / nullif(TotalOrders, 0)::double)::decimal(10,2) as AOV from channels",
        ),
        "kpi3_loss_product_rate": (
            ("products",),
            f"""select count(*) filter (Profit < 0) as LossProducts, count(*) as TotalProducts,
    {_percent('count(*) filter (Profit < 0)', 'count(*)', '8,2')} as LossProductRate from products""",
        ),
        "rfm_customers": (("segmented",), "select * from segmented"),
        "rfm_segments": (
            ("segments",),
            f"""select *, {_percent('NumCustomer', shares('NumCustomer', 'segments'), '5,2')} as PercentCustomer,
    {_percent('TotalRevenue', shares('TotalRevenue', 'segments'), '5,2')} as PercentRevenue from segments""",
        ),
        "d1_seasonal_dip": (
            ("growth",),
            """select OrderQuarter, count(RevenueGrowthPercent) as YearsCompared,
    count(*) filter (RevenueGrowthPercent is not null and TotalQuarterlyRevenue < PreviousQuarterRevenue) as YearsDeclined
  from growth group by OrderQuarter""",
        ),
        "d2_aov_ratio": (
            ("channels",),
            """with t as (select (sum(TotalRevenue) filter (SalesChannel = 'Offline'))::double / nullif(sum(TotalOrders) filter (SalesChannel = 'Offline'), 0)::double as off,
    (sum(TotalRevenue) filter (SalesChannel = 'Online'))::double / nullif(sum(TotalOrders) filter (SalesChannel = 'Online'), 0)::double as online from channels)
select off::decimal(10,2) as OfflineAOV, online::decimal(10,2) as OnlineAOV, (off / nullif(online, 0))::decimal(10,4) as AOVRatio from t""",
        ),
        "d3_topn_concentration": (
            ("products", "best"),
            f"""select count(*) as TopProducts, sum(Profit)::decimal(38,4) as TopProfit, {shares('Profit', 'products')}::decimal(38,4) as AllProfit,
    {_percent('sum(Profit)', shares('Profit', 'products'), '20,4')} as TopProfitSharePct from best""",
        ),
        "d4_line_profit_range": (
            ("best",),
            f"select {_line('Name', p)} as ProductLine, count(*) as SKUs, min(Profit) as MinProfit, max(Profit) as MaxProfit from best group by ProductLine",
        ),
        "d5_loss_products_all": (("losses",), "select * from losses"),
        "d6_reject_spread": (
            ("vendors",),
            "select count(*) as Vendors, min(RejectedRate) as MinRejectedRate, max(RejectedRate) as MaxRejectedRate from vendors",
        ),
        "d6_worst_product": (
            ("vendor_products",),
            """select * from vendor_products a where not exists (from vendor_products b where b.VendorID = a.VendorID and
    (b.TotalReject * a.TotalOrder > a.TotalReject * b.TotalOrder or b.TotalReject * a.TotalOrder = a.TotalReject * b.TotalOrder and b.ProductID < a.ProductID))""",
        ),
        "d7_margin_extremes": (
            ("quarters",),
            f"({extreme.format('Lowest', rate, 'asc')}) union all ({extreme.format('Highest', rate, 'desc')})",
        ),
        "d8_first_positive": (
            ("groups",),
            """select ProductType, OrderYear, OrderQuarter, ProfitRate from groups a where TotalProfit > 0 and not exists (from groups b
    where b.ProductType = a.ProductType and b.TotalProfit > 0 and b.OrderYear * 4 + b.OrderQuarter < a.OrderYear * 4 + a.OrderQuarter)""",
        ),
        "d9_segment_rollup": (
            ("segments",),
            f"""select SegmentSet, sum(NumCustomer)::bigint as NumCustomer, {_percent('sum(NumCustomer)', shares('NumCustomer', 'segments'), '5,2')} as PercentCustomer,
    sum(TotalRevenue)::decimal(38,4) as TotalRevenue, {_percent('sum(TotalRevenue)', shares('TotalRevenue', 'segments'), '5,2')} as PercentRevenue
  from ({members}) join segments using (Cus_Category) group by SegmentSet""",
        ),
        "d10_growth_run": (
            ("growth",),
            "with up as (select OrderYear as y, OrderQuarter as q, OrderYear * 4 + OrderQuarter as nth from growth where TotalQuarterlyRevenue > PreviousQuarterRevenue)\n"
            + _runs("up"),
        ),
        "d11_low_margin_run": (
            ("quarters",),
            f"with low as (select *, y * 4 + q as nth from quarters where revenue <> 0 and profit * 100 < revenue * {p.low_margin_pct}),\nrun as ("
            + _runs("low", ", @revenue as %TotalRevenue")
            + ")\nselect *, LastTotalRevenue > FirstTotalRevenue as RevenueGrew from run",
        ),
        "d12_group_margin_range": (
            ("groups",),
            f"""select ProductType, count(*) as Quarters, min(ProfitRate) as MinProfitRate, max(ProfitRate) as MaxProfitRate
  from groups where OrderYear * 4 + OrderQuarter >= {first} and OrderYear * 4 + OrderQuarter <= {last} group by ProductType""",
        ),
        "d13_line_profit_share": (
            ("products",),
            f"""select {_line('Name', p)} as ProductLine, count(*) as Products, sum(Profit)::decimal(38,4) as TotalProfit,
    {_percent('sum(Profit)', shares('Profit', 'products'), '20,4')} as ProfitSharePct from products group by ProductLine""",
        ),
    }


def oracle_sql(p: Params = STANDIN_PARAMS, inline_views: bool = True) -> dict[str, str]:
    """SQL per result. With ``inline_views=False`` the statements expect
    reference-shaped tables named like the views (soh, sod, cust, terr,
    prod, poh, pod, vend, wo, sr) to exist already."""
    tables = {**({k: ((), q) for k, q in VIEWS.items()} if inline_views else {}), **_tables(p)}

    def needed(names: tuple[str, ...], have: dict[str, str]) -> dict[str, str]:
        for n in names:
            if n in tables and n not in have:
                needed(tables[n][0], have)
                have[n] = tables[n][1]
        return have

    out = {}
    for name, (reads, body) in _results(p).items():
        ctes = [f"{n} as (\n{q}\n)" for n, q in needed(reads, {}).items()]
        if body.startswith("with "):  # the result's own tables come after the shared ones
            body = body[5:] if ctes else body
            out[name] = ("with " + ",\n".join(ctes) + ",\n" + body) if ctes else body
        else:
            out[name] = ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
    return out
