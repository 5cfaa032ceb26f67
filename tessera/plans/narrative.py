"""Narrative queries: conversations as report pages, the lines of their turns as runs of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import narrative as N
from ..registry import query, table

RUNS = """
with lines as (select conv_id as page, turn, role, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i, unnest(string_split(coalesce(text, ''), chr(10))) as line from conversations),
raw as (select page, turn * 100 + i as object, case when turn % 4 = 2 and i = 0 then 'Summary ' || (page % 9) || ':' when turn % 6 = 5 and i = 1 then 'Source: page' when turn % 7 = 3 and i = 0 then 'TICKER' when role = 'user' and turn % 3 = 0 then left(line, 60) else line end as text,
  (case when role = 'user' and turn % 3 = 0 and i = 0 then 12.0 when (page + turn) % 11 = 0 then 6.5 else 9.0 + (page + i) % 2 * 0.5 end)::double as size, (case when role = 'user' then 40 when (turn + i) % 5 = 0 then 300 when (turn + i) % 7 = 0 then 20 else 42 end)::double as x0,
  (100 + turn * 55 + i * (10 + page % 3 * 9))::double as y0, (turn + i) % 3 as z, (page + turn + i) % 13 = 0 as bent from lines),
boxed as (select *, x0 + 2 * length(text) as x1, y0 + case when bent then -1 else 9 end as y1 from raw),
runs as (select *, row_number() over (partition by page order by y0, x0, z, object) as nth from (select page, object, trim(text) as text, size, x0, y0, x1, y1, z from boxed) where text <> ''),
sides as (select page, floor(x0 / 4 + 0.5) * 4 as "left", sum(length(text)) as weight, min(nth) as first from runs where length(text) >= 20 and x0 between 0 and 595 * 0.82 group by all),
lefts as (select page, "left" from sides qualify row_number() over (partition by page order by weight desc, first) = 1),
bodies as (select page, list_sort(list(size))[count(*) // 2 + 1] as body from runs join lefts using (page) where abs(x0 - "left") <= 18 and length(text) >= 20 and size > 0 group by page),
r as (select runs.*, "left", body, regexp_matches(text, '[：:]($|\\s)') as colon, regexp_matches(text, '(?i)^(company|update|company update|research|research center)$') or regexp_matches(text, '(?i)^(자료|주|출처)\\s*[:：]') or regexp_matches(text, '(?i)^(sources?|notes?)\\s*[:：]') or regexp_matches(text, '(?i)^compliance notice\\b')
    or regexp_matches(text, '^[A-Z][A-Z0-9.&-]{0,14}$') or regexp_matches(text, '^\\(?[0-9]{4,6}\\)?$') or regexp_matches(text, '^[0-9]{4}[./-]\\s*[0-9]{1,2}[./-]\\s*[0-9]{1,2}$') as furniture
  from runs join lefts using (page) left join bodies using (page)),
heads as (select * from r where length(text) between 3 and 100 and (colon or (abs(x0 - "left") <= 18 and coalesce(size >= body * 1.07, false))) and regexp_matches(text, '[A-Za-z가-힣]') and not furniture and y0 between 842 * 0.18 and 842 * 0.84
  and exists (select 1 from runs n where n.page = r.page and n.nth > r.nth and length(n.text) >= 2 and n.y0 >= r.y0 - 1 and n.y0 - r.y1 <= 36 and n.x0 >= r.x0 - 10 and case when r.colon then n.size <= r.size * 1.05 else n.size < r.size * 0.98 end)),
ends as (select *, coalesce(lead(y0) over (partition by page order by nth), 836) as until from heads),
inside as (select e.page, e.nth as h, e.object as heading, e.y1 as bottom, x.object, x.nth, x.text, x.size, x.x0, x.y0, x.x1, x.y1, x.body, x.x1 >= x.x0 and x.y1 >= x.y0 as boxed from ends e join r x on x.page = e.page and x.y0 >= e.y0 - 1 and x.y0 < e.until and not x.furniture
  and not exists (select 1 from heads k where k.page = x.page and k.nth = x.nth) and ((x.x1 >= e."left" - 18 and x.x0 <= 595 * 0.96) or (e.colon and x.x0 >= e.x0 - 10 and x.x0 <= 595 * 0.94)) and (x.body is null or x.size between x.body * 0.78 and greatest(e.size * 1.05, x.body * 1.24))),
folded as (select *, greatest(bottom, coalesce(max(y1) over (partition by page, h, boxed order by nth rows between unbounded preceding and 1 preceding), bottom)) as prev, row_number() over (partition by page, h, boxed order by nth) as k from inside),
judged as (select *, boxed and sum(case when y0 - prev > case when k = 1 then greatest(42, coalesce(body, greatest(7, size)) * 4.2) else greatest(20, least(34, coalesce(body, greatest(7, size)) * 2.8)) end then 1 else 0 end) over (partition by page, h, boxed order by nth) = 0 as covered from folded)
"""


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    t = table(spark, sf_dir, "conversations")
    lines = t.select(c("conv_id").alias("page"), "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    user = (c("role") == "user") & (c("turn") % 3 == 0)
    text = (
        F.when((c("turn") % 4 == 2) & (c("i") == 0), F.concat(F.lit("Summary "), (c("page") % 9).cast("string"), F.lit(":"))).when((c("turn") % 6 == 5) & (c("i") == 1), "Source: page").when((c("turn") % 7 == 3) & (c("i") == 0), "TICKER")
        .when(user, F.substring("line", 1, 60)).otherwise(c("line"))
    )
    size = F.when(user & (c("i") == 0), 12.0).when((c("page") + c("turn")) % 11 == 0, 6.5).otherwise((c("page") + c("i")) % 2 * 0.5 + 9.0)
    left = F.when(c("role") == "user", 40).when((c("turn") + c("i")) % 5 == 0, 300).when((c("turn") + c("i")) % 7 == 0, 20).otherwise(42)
    top = c("turn") * 55 + c("i") * (c("page") % 3 * 9 + 10) + 100
    r = lines.select("page", (c("turn") * 100 + c("i")).alias("object"), text.alias("text"), size.cast("double").alias("size"), left.cast("double").alias("x0"), top.cast("double").alias("y0"), ((c("turn") + c("i")) % 3).alias("z"), ((c("page") + c("turn") + c("i")) % 13 == 0).alias("bent"))
    r = r.withColumn("x1", c("x0") + F.length("text") * 2).withColumn("y1", c("y0") + F.when(c("bent"), -1).otherwise(9))
    return r, t.select(c("conv_id").alias("page"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height")).distinct()


@query(RUNS + """
select page, heading, count(*) filter (covered) as runs, count(*) filter (not covered) as uncovered, min(x0) filter (covered) as x0, min(y0) filter (covered) as y0, max(x1) filter (covered)::double as x1, max(y1) filter (covered) as y1,
  left(regexp_replace(string_agg(text, ' ' order by nth) filter (covered), '\\s+', ' ', 'g'), 4000) as text from judged group by page, h, heading having count(*) filter (covered) > 0""")
def narrative_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a page's prose: heading, union of its runs' boxes, text, and how many runs it leaves uncovered."""
    return N.sections(*_pages(spark, sf_dir))[0].withColumn("x1", F.col("x1").cast("double"))


@query(RUNS + "select page, heading, object, covered from judged where (page, h) in (select (page, h) from judged where covered)")
def narrative_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every section, covered or behind a gap."""
    return N.sections(*_pages(spark, sf_dir))[1]
