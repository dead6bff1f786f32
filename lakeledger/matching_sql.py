"""DuckDB SQL that states what lexicon mining and fuzzy matching give, pair by pair and word by word."""

from __future__ import annotations

from .operators.lexicon import LEAST_BRANDS, LEAST_COLOR_BRANDS, LEAST_COLOR_COUNT, LEAST_COUNT, LEAST_LIFT
from .options import BASE_COLORS, BIOPOLYMERS, COLOR_SYNONYMS, COMPOSITE_SEEDS, FAMILY_PREFIXES, FINISH_TAGS, MODIFIER_SEEDS, STOP_WORDS
from .sources.views import with_views


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


BRAND = "trim(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def segments(rows: str) -> str:
    """(id, brand, seg, ws): residual words of the names in ``rows`` (id, name, vendor, material), by segment."""
    return f"""(
  select id, brand, seg, list_filter(regexp_split_to_array(part, '[^a-z0-9_]+'), lambda w: len(w) > 1 and not regexp_matches(w, '^\\d+[a-z]?$') and not list_contains(gone, w)) as ws from (
    select id, {BRAND.format("vendor")} as brand, unnest(regexp_split_to_array(lower(trim(name)), '[&/]')) as part, generate_subscripts(regexp_split_to_array(lower(trim(name)), '[&/]'), 1) as seg,
      list_concat(list_concat(string_split(lower(trim(vendor)), ' '), string_split(lower(trim(material)), ' ')), {listed(FINISH_TAGS)}) as gone
    from {rows}))"""


def lexicon(rows: str) -> str:
    """CTEs up to ``lexicon`` (kind, term, n, freq), mined from the names in ``rows``."""
    fixed = [("modifier", s) for s in sorted({*MODIFIER_SEEDS, *COMPOSITE_SEEDS} - {*STOP_WORDS, *BASE_COLORS})] + [("color", c) for c in sorted({*BASE_COLORS})]
    always = ", ".join(f"('{k}', '{t}', {len(t.split())})" for k, t in fixed)
    return f"""named as materialized {segments(rows)},
grams as (select brand, n, unnest(list_transform(generate_series(1, len(ws) - n + 1), lambda i: array_to_string(ws[i : i + n - 1], ' '))) as term from named, (select unnest([1, 2, 3]) as n) where len(ws) >= n),
counted as materialized (select n, term, count(*) as freq, count(distinct brand) as brands from grams group by all),
lifted as (
  select term from (select term, freq, string_split(term, ' ')[1] as a, string_split(term, ' ')[2] as b from counted where n = 2) p
  join (select term as a, freq as fa from counted where n = 1) using (a) join (select term as b, freq as fb from counted where n = 1) using (b)
  where freq * (select count(*) from {rows}) / (fa * fb) >= {LEAST_LIFT}),
often as (
  select n, term, freq from counted where freq >= {LEAST_COUNT} and brands >= {LEAST_BRANDS} and not (n = 1 and list_contains({listed(STOP_WORDS)}, term))
    and (n <> 2 or term in (select term from lifted))),
covering as (select n, string_split(term, ' ') as w from often where n > 1),
covered as (select unnest(w) as term from covering union select array_to_string(w[1 : 2], ' ') from covering where n = 3 union select array_to_string(w[2 : 3], ' ') from covering where n = 3),
mined as (select * from often where term not in (select term from covered) and not list_contains({listed(BASE_COLORS)}, term)),
found as (
  select 'modifier' as kind, term, n, freq from mined where not list_contains({listed(STOP_WORDS)}, term)
  union all select 'color', term, n, freq from counted where n = 1 and freq >= {LEAST_COLOR_COUNT} and brands >= {LEAST_COLOR_BRANDS}
    and not list_contains({listed((*BASE_COLORS, *STOP_WORDS, *MODIFIER_SEEDS))}, term) and term not in (select term from mined)),
lexicon as materialized (
  select * from found
  union all select kind, s.term, s.n, coalesce(freq, 0) from (values {always}) s(kind, term, n) left join counted c on c.term = s.term
  where not exists (select 1 from found f where f.kind = s.kind and f.term = s.term))"""


MINED = f"with {lexicon('(select p_partkey as id, p_name as name, p_brand as vendor, p_type as material from part)')} select * from lexicon"

#: How many words the term at word ``i`` has.
STEP = "case when i + 2 <= len(ws) and list_contains(ts, array_to_string(ws[i : i + 2], ' ')) then 3 when i + 1 <= len(ws) and list_contains(ts, array_to_string(ws[i : i + 1], ' ')) then 2 else 1 end"
WORDS_OF = "lower(name || ' ' || material)"
FINISHES = "list_sort(list_distinct(list_filter([" + ", ".join(f"case when regexp_matches({WORDS_OF}, '\\b{w}\\b') then {i} end" for w, i in FINISH_TAGS.items()) + "], lambda x: x is not null)))"


def _plain_material() -> str:
    out = "material"
    for word in sorted(FINISH_TAGS, key=lambda w: (-len(w), w)):
        out = f"regexp_replace({out}, '[\\s_-]*{word}[\\s_-]*', ' ', 'gi')"
    return f"coalesce(nullif(trim(regexp_replace({out}, '\\s+', ' ', 'g')), ''), trim(material))"


FAMILY = "case " + " ".join(f"when starts_with(plain, '{p}') and not regexp_matches(substr(plain, {len(p) + 1}, 1), '[a-z]') then '{f}'" for p, f in FAMILY_PREFIXES) + " else plain end"
SYNONYM = "case term " + " ".join(f"when '{a}' then '{b}'" for a, b in COLOR_SYNONYMS.items()) + " else term end"
RGB = ", ".join(f"case when regexp_matches(ltrim(hex, '#'), '^[0-9A-Fa-f]{{6}}') then ('0x' || substr(ltrim(hex, '#'), {1 + 2 * k}, 2))::int::double end as {c}" for k, c in enumerate("rgb"))

#: CTEs up to ``scored`` (left_id, right_id, score): every pair of one brand past the gates.
SCORED = with_views(
    f"""sources as (
  select 'l' as side, cast(id as varchar) as id, name, vendor, material, coalesce(color_hex, '') as hex,
    case when coalesce(multi, '') = '' then 'single' when direction = 'coaxial' then 'coextruded' when direction = 'longitudinal' then 'gradient' else 'multi_unknown' end as profile,
    case when coalesce(multi, '') <> '' then 1 + len(string_split(multi, ',')) when coalesce(color_hex, '') <> '' then 1 else 0 end as hexes
  from left_product join left_palette using (id)
  union all
  select 'r', id, name, vendor, type, coalesce(color, ''),
    case when list_contains(string_split(tags_csv, ','), '29') then 'coextruded' when list_contains(string_split(tags_csv, ','), '28') then 'gradient' when len(string_split(secondary_csv, ',')) >= 2 then 'multi_unknown' else 'single' end,
    case when coalesce(color, '') <> '' then 1 else 0 end + len(list_filter(string_split(secondary_csv, ','), lambda h: h <> ''))
  from right_product join right_palette using (id)),
{lexicon("(select id, name, vendor, type as material from right_product)")},
terms as (select list(term) as ts from lexicon),
texts as materialized (select id as pid, seg, ws, ts from {segments("(select side || id as id, name, vendor, material from sources)")} x, terms),
starts(pid, seg, ws, ts, i) as (select pid, seg, ws, ts, 1::bigint from texts where len(ws) > 0 union all select pid, seg, ws, ts, i + {STEP} from starts where i + {STEP} <= len(ws)),
items as (select pid, n, term, list_contains(ts, term) as known from (select pid, n, ts, array_to_string(ws[i : i + n - 1], ' ') as term from (select *, {STEP} as n from starts))),
colors as materialized (select pid, {SYNONYM} as color, count(*) as c from items where n = 1 and known and list_contains({listed(BASE_COLORS)}, term) group by all),
modifiers as materialized (select distinct pid, term from items where not (n = 1 and known and list_contains({listed(BASE_COLORS)}, term)) and (known or (len(term) >= 6 and ends_with(term, 'fill')))),
products as materialized (
  select side, id, side || id as pid, {BRAND.format("vendor")} as brand, case when coalesce(material, '') = '' then '' else {FAMILY} end as family, finishes, r, g, b, profile, hexes,
    greatest(hexes, coalesce(n_named, 0)) as arity, coalesce(n_named, 0) as n_named, coalesce(n_modifiers, 0) as n_modifiers
  from (select *, lower({_plain_material()}) as plain, {FINISHES} as finishes, {RGB} from sources) s
  left join (select pid, sum(c) as n_named from colors group by pid) c on c.pid = s.side || s.id
  left join (select pid, count(*) as n_modifiers from modifiers group by pid) m on m.pid = s.side || s.id),
pairs as materialized (
  select a.id as left_id, b.id as right_id, a.pid as ap, b.pid as bp, a.family as af, b.family as bf, a.finishes as ax, b.finishes as bx, a.n_named as an, b.n_named as bn, a.n_modifiers as am, b.n_modifiers as bm,
    case when a.r is null or b.r is null then 0.5 else sqrt((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) / (255 * sqrt(3.0::double)) end as distance
  from products a join products b on a.brand = b.brand and a.side = 'l' and b.side = 'r'
  where (b.family = '' or a.family = b.family or (list_contains({listed(BIOPOLYMERS)}, a.family) and list_contains({listed(BIOPOLYMERS)}, b.family)))
    and case when a.profile in ('coextruded', 'gradient') and b.profile in ('coextruded', 'gradient') and a.hexes >= 2 and b.hexes >= 2 then a.profile = b.profile else (a.arity >= 2) = (b.arity >= 2) end),
both_colors as (select ap, bp, sum(least(x.c, y.c)) as n from pairs join colors x on x.pid = ap join colors y on y.pid = bp and y.color = x.color group by all),
both_modifiers as (select ap, bp, count(*) as n from pairs join modifiers x on x.pid = ap join modifiers y on y.pid = bp and y.term = x.term group by all),
scored as materialized (
  select left_id, right_id, round(0.0::double
    + 0.15::double * case when af = bf then 1.0::double when contains(af, bf) or contains(bf, af) then 0.5::double else 0.0::double end
    + 0.15::double
    + 0.40::double * case when an = 0 or bn = 0 then 0.5::double else coalesce(c.n, 0) / (an + bn - coalesce(c.n, 0))::double end
    + 0.15::double * case when am = 0 and bm = 0 then 0.5::double when am = 0 or bm = 0 then 0.0::double else coalesce(m.n, 0) / (am + bm - coalesce(m.n, 0))::double end
    + case when len(ax) = 0 and len(bx) = 0 then 0.05::double when len(ax) = 0 or len(bx) = 0 then -0.10::double when len(list_intersect(ax, bx)) = 0 then -0.07::double
        else 0.10::double * len(list_intersect(ax, bx)) / (len(ax) + len(bx) - len(list_intersect(ax, bx))) end
    + case when distance <= 0.5 then greatest(0.0::double, 0.05::double * (1 - distance / 0.5)) else 0.0::double end, 4) as score
  from pairs left join both_colors c using (ap, bp) left join both_modifiers m using (ap, bp))""",
    "left_product", "right_product", "left_palette", "right_palette",
).replace("with ", "with recursive ", 1)

RANKED = f"""{SCORED},
placed as (select *, row_number() over (partition by left_id order by score desc, right_id) as rank, max(score) over (partition by left_id) as top from scored)
select left_id::bigint as left_id, right_id, score, rank, case when rank = 1 and score >= 0.3 then 'best' else 'alternate' end as role
from placed where rank <= 11 and (top >= 0.3 or rank <= 10)"""

REASONS = f"""{SCORED},
best as (select left_id, max(score) as score from scored group by left_id)
select p.id::bigint as id, case when p.brand = '' then 'no_vendor' when p.brand not in (select brand from products where side = 'r') then 'unknown_brand' when b.left_id is null then 'gated' else 'low_score' end as reason
from products p left join best b on b.left_id = p.id where p.side = 'l' and coalesce(b.score, 0) < 0.8"""
