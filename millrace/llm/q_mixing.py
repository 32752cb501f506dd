"""op5: raked drawing probabilities and draws of all documents."""

from .common import table
from .mixing import ALPHA, BUDGET, DIMS, LOOK, MOST, TOLERANCE, mixing_weights


def op5_mix_sources(spark, sf_dir):
    return mixing_weights(table(spark, sf_dir, "documents"))


QUERIES = {"op5_mix_sources": op5_mix_sources}


def oracle(docs: str = "documents", result: str = "select doc_id, n_tokens, topic, round(least(1.0, factor), 6) as probability, u < least(1.0, factor) as kept from drawn") -> str:
    """The sweeps as a recursive table expression."""
    ctes = [
        rf"""stats as (
  select *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::bigint as chars
  from {docs}
)""",
        """keyed as (
  select *, coalesce(source, chr(0)) as k0, coalesce(lang, chr(0)) as k1, topic as k2,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '#1'), 1, 13))::bigint / 4503599627370496.0::double as u
  from (select *, case when n_tokens < 100 then 'short' when n_tokens < 600 then 'medium' else 'long' end
    || case when chars < 4.5 * n_tokens then '-plain' when chars < 6 * n_tokens then '-mixed' else '-dense' end as topic from stats)
)""",
        "cells as (select k0, k1, k2, sum(n_tokens)::double as tokens from keyed group by all)",
        "total as (select sum(tokens) as t from cells)",
    ]
    for i in range(len(DIMS)):
        ctes.append(f"have{i} as (select k{i}, sum(tokens) as have, pow(sum(tokens), {ALPHA}) as share from cells group by all)")
        ctes.append(
            f"""full{i} as (
  select *, share > 0 and ({BUDGET} * t - coalesce(sum(have) over (w rows between unbounded preceding and 1 preceding), 0)) / sum(share) over (w rows between current row and unbounded following) * share >= have as fullup
  from have{i}, total window w as (order by case when share > 0 then coalesce(share / nullif(have, 0), 'infinity'::double) else 0 end desc, k{i})
)"""
        )
        ctes.append(f"goal{i} as (select k{i}, case when fullup then have when share > 0 then ({BUDGET} * t - sum(case when fullup then have else 0 end) over ()) / sum(case when fullup then 0 else share end) over () * share else 0 end as g{i}, fullup as f{i} from full{i})")
    inner = "raked"
    for i in range(len(DIMS)):
        ratio = f"case when m > 0 and g{i} > c then (g{i} - c) / m when c + m > 0 then g{i} / (c + m) else 1 end"
        sums = f"sum(case when factor >= 1 then tokens else 0 end) over (partition by k{i}) as c, sum(case when factor < 1 then tokens * factor else 0 end) over (partition by k{i}) as m"
        inner = f"(select * exclude (c, m) replace (case when whole then factor else factor * {ratio} end as factor) from (select *, {sums} from {inner}))"
    off = "greatest(" + ", ".join(f"case when g{i} > 0 then abs(sum(tokens * least(1.0, factor)) over (partition by k{i}) / g{i} - 1) else 0 end" for i in range(len(DIMS))) + ")"
    ctes.append(
        f"""raked as (
  select k0, k1, k2, tokens, g0, g1, g2, whole, case when whole then 1e6 else {BUDGET} end::double as factor, 0 as sweep, false as done
  from (select *, (f0 or f1 or f2) and g0 > 0 and g1 > 0 and g2 > 0 as whole from cells join goal0 using (k0) join goal1 using (k1) join goal2 using (k2))
  union all
  select k0, k1, k2, tokens, g0, g1, g2, whole, factor, sweep + 1, (sweep + 1) % {LOOK} = 0 and max(off) over () <= {TOLERANCE} from (select *, {off} as off from {inner.replace("from raked", "from raked where not done and sweep < " + str(MOST))})
)"""
    )
    ctes.append("fitted as (select k0, k1, k2, factor from raked where sweep = (select max(sweep) from raked))")
    ctes.append("drawn as (select keyed.*, factor from keyed join fitted using (k0, k1, k2))")
    return "with recursive " + ",\n".join(ctes) + "\n" + result


ORACLES = {"op5_mix_sources": oracle()}
