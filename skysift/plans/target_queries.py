"""Registered queries on target lists, download scripts, links, light curves and job registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lightcurves, registry, relational, targets
from ..sources import downloads, fits
from .registered import query, rounded, table


# Every row takes part; some under ids that the other side lacks.
_ORDER_ID = "case when o_orderpriority = '5-LOW' then -o_custkey else o_custkey end"
_CUSTOMER_ID = "case when c_mktsegment = 'BUILDING' then c_custkey + 1000000000 else c_custkey end"


def _urgent(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", F.expr(_ORDER_ID).alias("tic"))


def _builders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.expr(_CUSTOMER_ID).alias("tic"))


_SIDES = f"""urgent as (select o_orderkey, {_ORDER_ID} as tic from orders),
builders as (select {_CUSTOMER_ID} as tic from customer)"""


@query("target_semi", f"with {_SIDES} select tic, o_orderkey from urgent where tic in (select tic from builders)")
def target_semi(spark: SparkSession, folder: str) -> DataFrame:
    return relational.rows_with_id(_urgent(spark, folder), _builders(spark, folder), "tic")


@query(
    "target_anti",
    f"""with {_SIDES} select tic, o_orderkey from urgent
    where not exists (select 1 from builders where builders.tic = urgent.tic)""",
)
def target_anti(spark: SparkSession, folder: str) -> DataFrame:
    return relational.rows_without_id(_urgent(spark, folder), _builders(spark, folder), "tic")


@query("target_intersect", f"with {_SIDES} select tic from urgent intersect select tic from builders")
def target_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return relational.common_ids(_urgent(spark, folder), _builders(spark, folder), "tic")


@query("target_except", f"with {_SIDES} select tic from urgent except select tic from builders")
def target_except(spark: SparkSession, folder: str) -> DataFrame:
    return relational.only_left_ids(_urgent(spark, folder), _builders(spark, folder), "tic")


@query(
    "target_comparison",
    f"""with {_SIDES},
    l as (select distinct tic from urgent), r as (select distinct tic from builders)
    select count(*) filter (r.tic is null) as left_only, count(*) filter (l.tic is null) as right_only,
      count(*) filter (l.tic is not null and r.tic is not null) as common,
      count(l.tic) as left_total, count(r.tic) as right_total
    from l full join r on l.tic = r.tic""",
)
def target_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return targets.comparison_counts(_urgent(spark, folder), _builders(spark, folder), "tic")


@query(
    "dedupe_keep_first",
    """select o_custkey, o_orderkey, o_totalprice, o_orderpriority from (
      select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders)
    where place = 1""",
)
def dedupe_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").drop("o_orderstatus")
    return relational.keep_first(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    """Sectors by user: the hour of an event stands for its sector."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("tic_id"), (F.hour("ts") + 1).alias("sector")
    )


_OBSERVED = "observed as (select distinct user_id as tic_id, cast(hour(ts) + 1 as int) as sector from events)"


@query(
    "target_prepare",
    f"with {_OBSERVED} select tic_id, sector || '-' || sector as sector_run from observed",
)
def target_prepare(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "events").select(F.col("user_id").alias("tic_id"))
    return targets.prepare_targets(ids, _observations(spark, folder))


@query(
    "target_explode",
    f"with {_OBSERVED} select tic_id, sector || '-' || sector as sector_run from observed",
)
def target_explode(spark: SparkSession, folder: str) -> DataFrame:
    return targets.prepare_targets(targets.observed_sectors(_observations(spark, folder)))


@query(
    "target_sectors",
    f"""with pairs as (select distinct {_ORDER_ID} as tic_id, month(o_orderdate) as sector from orders)
    select c_custkey as tic_id, coalesce(string_agg(sector, ',' order by sector), '') as sectors
    from customer left join pairs on c_custkey = tic_id group by c_custkey""",
)
def target_sectors(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    seen = orders.select(F.expr(_ORDER_ID).alias("tic_id"), F.month("o_orderdate").alias("sector"))
    ids = table(spark, folder, "customer").select(F.col("c_custkey").alias("tic_id"))
    lists = targets.observed_sectors(seen, ids, keep_missing=True)
    return lists.select("tic_id", F.array_join("sectors", ",").alias("sectors"))


@query(
    "target_list_summary",
    f"""with {_OBSERVED}, runs as (select tic_id, sector || '-' || sector as sector_run from observed)
    select count(*) as total_tics, count(distinct sector_run) as distinct_runs,
      (select string_agg(tic_id, ',' order by tic_id) from (select tic_id from runs order by tic_id limit 10))
        as first_tic_ids
    from runs""",
)
def target_list_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = targets.target_list_summary(targets.observed_runs(_observations(spark, folder)))
    return summary.withColumn("first_tic_ids", F.array_join("first_tic_ids", ","))


_RUN_TEXT = """case o_orderstatus
  when 'F' then concat('s', lpad(cast(month(o_orderdate) as {text}), 4, '0'), '-s', lpad(cast(year(o_orderdate) as {text}), 4, '0'))
  when 'O' then concat(cast(month(o_orderdate) as {text}), '-', cast(year(o_orderdate) as {text}))
  else o_orderpriority end"""


@query(
    "sector_parse",
    f"""with runs as (select o_orderkey, {_RUN_TEXT.format(text="varchar")} as sector_run from orders)
    select o_orderkey, sector_run,
      try_cast(nullif(regexp_extract(sector_run, '^\\s*s?(\\d+)-s?(\\d+)\\s*$', 1), '') as int) as first_sector,
      try_cast(nullif(regexp_extract(sector_run, '^\\s*s?(\\d+)-s?(\\d+)\\s*$', 2), '') as int) as last_sector
    from runs""",
)
def sector_parse(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "orders").select("o_orderkey", F.expr(_RUN_TEXT.format(text="string")).alias("sector_run"))
    parsed = runs.withColumn("p", S.parse_sector_run(F.col("sector_run")))
    return parsed.select("o_orderkey", "sector_run", "p.first_sector", "p.last_sector")


@query(
    "sector_runs",
    f"""with runs as (select distinct {_RUN_TEXT.format(text="varchar")} as sector_run from orders)
    select sector_run,
      try_cast(nullif(regexp_extract(sector_run, '^\\s*s?(\\d+)-s?(\\d+)\\s*$', 1), '') as int) as first_sector,
      try_cast(nullif(regexp_extract(sector_run, '^\\s*s?(\\d+)-s?(\\d+)\\s*$', 2), '') as int) as last_sector
    from runs""",
)
def sector_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "orders").select(F.expr(_RUN_TEXT.format(text="string")).alias("sector_run"))
    return targets.distinct_runs(runs)


_FILE = """concat('tess2021118034608-s', lpad(cast(month(o_orderdate) as {text}), 4, '0'), '-',
  lpad(cast(o_custkey as {text}), 16, '0'), '-0209-s_lc.fits')"""
_LINE = """case o_orderpriority
  when '5-LOW' then concat('# ', {file})
  when '4-NOT SPECIFIED' then concat('curl -C - -L -o ', {file})
  else concat('  curl -C - -L -o ', {file}, ' https://archive.example/api/download/?uri=mast:TESS/product/', {file}) end"""


def _script_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = _LINE.format(file=_FILE.format(text="string"))
    return table(spark, folder, "orders").select(
        F.expr(line).alias("value"), F.col("o_orderstatus").alias("script"), F.col("o_orderkey").alias("place")
    )


_LINES = f"""lines as (select {_LINE.format(file=_FILE.format(text="varchar"))} as value,
  o_orderstatus as script, o_orderkey as place from orders)"""
_TARGETS = f"""{_LINES}, found as (
  select script, place, regexp_extract(value, '(https://[^\\s]+)', 1) as url from lines
  where regexp_matches(value, '^\\s*curl') and regexp_matches(value, 'https://[^\\s]+')),
named as (select *, regexp_extract(url, '/([^/]+\\.fits)', 1) as filename from found),
listed as (select filename, url, cast(regexp_extract(filename, '-0+(\\d+)-', 1) as bigint) as tic, script, place
  from named where cast(regexp_extract(filename, '-0+(\\d+)-', 1) as bigint) <> 0)"""


@query(
    "script_parse",
    f"""with {_TARGETS} select filename, url, tic, cast(regexp_extract(filename, '-s(\\d+)-', 1) as int) as sector,
      script, place from listed""",
)
def script_parse(spark: SparkSession, folder: str) -> DataFrame:
    listed = downloads.targets_in_lines(_script_lines(spark, folder))
    return listed.withColumn("sector", S.sector_from_name(F.col("filename")))


@query(
    "lc_dv_targets",
    f"""with {_SIDES}, {_TARGETS},
    lc as (select * from (select *, row_number() over (partition by tic order by script, place) as n from listed) where n = 1),
    dv as (select distinct tic from builders)
    select filename, url, tic from lc where tic in (select tic from dv)""",
)
def lc_dv_targets(spark: SparkSession, folder: str) -> DataFrame:
    lc = targets.first_per_target(downloads.targets_in_lines(_script_lines(spark, folder)))
    kept, _ = targets.intersect_targets(lc, _builders(spark, folder))
    return kept.select("filename", "url", "tic")


@query(
    "lc_dv_counts",
    f"""with {_SIDES}, {_TARGETS}, l as (select distinct tic from listed), r as (select distinct tic from builders)
    select count(*) filter (r.tic is null) as left_only, count(*) filter (l.tic is null) as right_only,
      count(*) filter (l.tic is not null and r.tic is not null) as common,
      count(l.tic) as left_total, count(r.tic) as right_total
    from l full join r on l.tic = r.tic""",
)
def lc_dv_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How the targets of the two kinds of files compare."""
    lc = targets.first_per_target(downloads.targets_in_lines(_script_lines(spark, folder)))
    _, counts = targets.intersect_targets(lc, _builders(spark, folder))
    return counts


@query(
    "page_links",
    r"""with clean as (select page_id, regexp_replace(html,
      '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') as html from pages),
    found as (select page_id, unnest(hrefs) as raw, generate_subscripts(hrefs, 1) - 1 as position from (
      select page_id, regexp_extract_all(html,
        '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1) as hrefs from clean)),
    bare as (select page_id, position, regexp_replace(raw, '^["'']|["'']$', '', 'g') as raw from found),
    links as (select page_id, position, trim(replace(replace(replace(replace(replace(raw,
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as href from bare)
    select page_id, href, cast(min(position) as int) as position from links where href <> '' group by page_id, href""",
)
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return downloads.page_links(table(spark, folder, "pages"))


@query(
    "free_text_ids",
    r"""with texts as (select l_orderkey, l_linenumber,
      concat(l_orderkey, ', ', l_returnflag, l_suppkey, ' ', l_partkey, chr(10), l_shipdate::date) as text from lineitem)
    select l_orderkey, l_linenumber, cast(token as bigint) as number from (
      select l_orderkey, l_linenumber, unnest(string_split_regex(text, '[,\n\s]+')) as token from texts)
    where regexp_matches(token, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')""",
)
def free_text_ids(spark: SparkSession, folder: str) -> DataFrame:
    text = "concat(l_orderkey, ', ', l_returnflag, l_suppkey, ' ', l_partkey, '\\n', cast(l_shipdate as date))"
    texts = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.expr(text).alias("text"))
    found = targets.ids_in_text(texts, "text", ["l_orderkey", "l_linenumber"])
    return found.withColumn("number", F.col("number").cast("bigint"))


@query(
    "pair_by_position",
    """select o_custkey as tic_id, month(o_orderdate) as sector from orders where o_orderstatus <> 'P'
    union all select o_orderkey, year(o_orderdate) from orders where o_orderstatus <> 'P'""",
)
def pair_by_position(spark: SparkSession, folder: str) -> DataFrame:
    sectors = """case when o_orderstatus <> 'P' then array(month(o_orderdate), year(o_orderdate))
      else array(month(o_orderdate)) end"""
    given = table(spark, folder, "orders").select(
        F.array("o_custkey", "o_orderkey").alias("ids"), F.expr(sectors).alias("sectors")
    )
    return targets.pair_targets(given).select("tic_id", F.col("sector").cast("bigint").alias("sector"))


_CURVES = "curves as (select user_id as TIC, hour(ts) as SECTOR, value from events)"


@query(
    "lightcurve_summary",
    f"""with {_CURVES} select count(*) as total_rows, count(distinct TIC) as targets,
      count(distinct SECTOR) as sectors, min(TIC) as tic_min, max(TIC) as tic_max,
      (select string_agg(SECTOR, ',' order by SECTOR) from (select distinct SECTOR from curves)) as sector_list
    from curves""",
)
def lightcurve_summary(spark: SparkSession, folder: str) -> DataFrame:
    curves = table(spark, folder, "events").select(F.col("user_id").alias("TIC"), F.hour("ts").alias("SECTOR"))
    summary = lightcurves.lightcurve_summary(curves)
    return summary.withColumn("sector_list", F.array_join("sector_list", ","))


_STATUS = "case event_type when 'error' then 'failed' when 'view' then 'skipped' else 'success' end"


@query(
    "status_summary",
    f"""select {_STATUS} as status, count(*) as files, cast(sum(user_id) as bigint) as size
    from events group by 1""",
)
def status_summary(spark: SparkSession, folder: str) -> DataFrame:
    status = table(spark, folder, "events").select(F.expr(_STATUS).alias("status"), "user_id")
    return lightcurves.status_summary(status, "user_id")


# --- light-curve files built from the customers: two rows each, some cut short or misnamed ---

_PRIMARY = ("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "END")
_TABLE = (
    "XTENSION= 'BINTABLE'           / binary table", "BITPIX  =                    8", "NAXIS   =                    2",
    "NAXIS1  =                   22", "NAXIS2  =                    2", "PCOUNT  =                    0",
    "GCOUNT  =                    1", "TFIELDS =                    3", "TTYPE1  = 'TIME    '           / number of the point",
    "TFORM1  = 'K       '", "TTYPE2  = 'FLUX    '", "TFORM2  = 'J       '", "TTYPE3  = 'NOTE    '",
    "TFORM3  = '10A     '", "EXTNAME = 'LIGHTCURVE'", "END",
)
_READ_AS = "TIME bigint, FLUX int, NOTE string"


def _block(cards) -> str:
    return "".join(card.ljust(80) for card in cards).ljust(2880)


def _be(value: Column, digits: int) -> Column:
    """Big-endian bytes of a whole number, as hex text."""
    return F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - digits, digits)


def _curve_files(spark: SparkSession, folder: str) -> DataFrame:
    # Files are costly to build and decode, and the customers are few rows of one scan task.
    c = table(spark, folder, "customer").repartition(spark.sparkContext.defaultParallelism)
    note = F.hex(F.rpad("c_mktsegment", 10, " "))
    point = F.col("c_custkey") * 10
    rows = F.concat(
        _be(point, 16), _be(F.col("c_nationkey"), 8), note, _be(point + 1, 16), _be(F.floor("c_acctbal"), 8), note
    )
    data = F.unhex(F.rpad(rows, 2 * 2880, "0"))
    whole = F.concat(F.lit(_block(_PRIMARY) + _block(_TABLE)).cast("binary"), data)
    content = F.when(F.col("c_mktsegment") == "MACHINERY", F.substring(whole, 1, 3000)).otherwise(whole)
    sector = F.when(F.col("c_mktsegment") == "FURNITURE", "none").otherwise("s0038")
    name = F.concat(F.lit("tess2021-"), sector, F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 16, "0"), F.lit("-0209-s_lc.fits"))
    return c.select(name.alias("filename"), content.alias("content"))


@query(
    "lightcurve_decode",
    """with files as (select * from customer where c_mktsegment not in ('MACHINERY', 'FURNITURE'))
    select c_custkey * 10 as "TIME", c_nationkey as "FLUX", c_mktsegment as "NOTE", c_custkey as "TIC",
      38 as "SECTOR" from files
    union all
    select c_custkey * 10 + 1, cast(floor(c_acctbal) as int), c_mktsegment, c_custkey, 38 from files""",
)
def lightcurve_decode(spark: SparkSession, folder: str) -> DataFrame:
    return fits.read_light_curves(_curve_files(spark, folder), _READ_AS)


@query(
    "lightcurve_status",
    """select case when c_mktsegment in ('MACHINERY', 'FURNITURE') then 'failed' else 'success' end as status,
      count(*) as files, cast(coalesce(sum(case when c_mktsegment not in ('MACHINERY', 'FURNITURE') then 2 end), 0)
      as bigint) as size
    from customer group by 1""",
)
def lightcurve_status(spark: SparkSession, folder: str) -> DataFrame:
    return lightcurves.status_summary(fits.light_curve_status(_curve_files(spark, folder), _READ_AS), "rows")


def _cards_sql() -> str:
    rows = []
    for hdu, (title, cards) in enumerate((("PRIMARY", _PRIMARY), ("LIGHTCURVE", _TABLE))):
        for card in cards[:-1]:
            value, _, comment = card[10:].partition("/")
            value = value.strip().strip("'").strip()
            rows.append(f"({hdu}, '{title}', '{card[:8].strip()}', '{value}', '{comment.strip()}')")
    return ", ".join(rows)


@query(
    "fits_headers",
    f"""with cards(hdu, hdu_name, key, value, comment) as (values {_cards_sql()})
    select hdu, hdu_name, key, value, comment, count(*) as files from cards, customer
    where hdu = 0 or c_mktsegment <> 'MACHINERY' group by all""",
)
def fits_headers(spark: SparkSession, folder: str) -> DataFrame:
    cards = fits.read_headers(_curve_files(spark, folder))
    return cards.groupBy("hdu", "hdu_name", "key", "value", "comment").agg(F.count("*").alias("files"))


# --- registries: every order stands for a job ------------------------------------------------

NOW = "1998-01-01 00:00:00"


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    status = "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end"
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("analysis_id"),
        F.expr(status).alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", day).alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", day).alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("duration_seconds"),
        F.when(F.col("o_orderstatus") == "F", F.lit(100)).alias("progress"),
    )


_JOBS = """jobs as (select o_orderkey as analysis_id,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status,
  case when o_orderpriority <> '5-LOW' then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as created_at,
  case when o_orderstatus = 'O' then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as started_at,
  case when o_orderstatus <> 'O' then o_totalprice end as duration_seconds,
  case when o_orderstatus = 'F' then 100 end as progress from orders)"""


@query(
    "registry_sorted",
    f"""with {_JOBS} select analysis_id, status, created_at from jobs
    order by coalesce(created_at, '') desc, analysis_id limit 50""",
)
def registry_sorted(spark: SparkSession, folder: str) -> DataFrame:
    ordered = registry.newest_first(_jobs(spark, folder), then_by=["analysis_id"])
    return ordered.select("analysis_id", "status", "created_at").limit(50)


@query(
    "registry_listing",
    f"""with {_JOBS} select analysis_id, status, created_at from jobs
    order by coalesce(created_at, '') desc, analysis_id""",
)
def registry_listing(spark: SparkSession, folder: str) -> DataFrame:
    ordered = registry.newest_first(_jobs(spark, folder), then_by=["analysis_id"])
    return ordered.select("analysis_id", "status", "created_at")


@query(
    "job_status",
    f"""with {_JOBS} select analysis_id, status, created_at, started_at, coalesce(progress, 0) as progress,
      round(case when status = 'running' and started_at is not null
        then cast(epoch(timestamp '{NOW}' - cast(started_at as timestamp)) as double)
        else coalesce(duration_seconds, 0) end, 6) as duration_seconds from jobs""",
)
def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(registry.job_status(_jobs(spark, folder), NOW))


@query(
    "retention",
    f"""with {_JOBS} select analysis_id, status, created_at from jobs
    where status in ('completed', 'failed', 'error')
      and floor(epoch(timestamp '{NOW}' - cast(created_at as timestamp)) / 86400) > 7""",
)
def retention(spark: SparkSession, folder: str) -> DataFrame:
    return registry.cleanup_candidates(_jobs(spark, folder), NOW).select("analysis_id", "status", "created_at")
