"""Building blocks of the oracle SQL (DuckDB), written from the table side:
positions and encodings are spelled out as arithmetic, not taken from the
package's layout."""

from __future__ import annotations

from fieldloom.plans.matches import BRANDS, PRIORITIES, RECORD_STRIDE, TYPES


def text_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


BRAND_LIST = text_list(BRANDS + ("",))
TYPE_LIST = text_list(TYPES + ("",))
PRIORITY_LIST = text_list(PRIORITIES + ("",))
FLAG_LIST = text_list(("A", "N", "R"))


def leaky(v: str) -> str:
    return f"case when {v} > 0 then {v} else {v} * 0.2::double end"


def weight(i: str, j: str, scale: float) -> str:
    return f"((({i}) * 31 + ({j}) * 17) % 13 - 6) / {scale}::double"


def bias(j: str, scale: float) -> str:
    return f"((({j}) * 7) % 5 - 2) / {scale}::double"


def last_bias(j: str, scale: float) -> str:
    return f"{bias(j, scale)} + (({j}) % 7 + 1) * 0.000001::double"


def draw(*parts: str) -> str:
    """Uniform draw from an md5 prefix; parts are SQL text expressions."""
    text = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::double"


def unpivot(family: str, value: str, kind: str, source: str = "slots") -> str:
    num, txt = ("null::double", value) if kind == "enum" else (f"({value})::double", "null::varchar")
    return (
        f"select 'participants.' || slot || '.{family}' as path, {num} as num, {txt} as txt "
        f"from {source} where {value} is not null"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "slots": (
        (),
        f"""select l_suppkey * {RECORD_STRIDE} + cast(floor((rn-1)/10) as bigint) as rec_id,
            cast((rn-1) % 10 as int) as slot, p_brand as brand, p_type as ptype, p_size as psize,
            cast(l_quantity as int) as quantity, l_extendedprice as price, l_discount as discount,
            l_returnflag as returnflag, l_linestatus as linestatus, o_orderpriority as priority,
            l_shipdate as shipdate
        from (select l.*, row_number() over (partition by l_suppkey
                order by l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) as rn
              from lineitem l) x
        left join part on p_partkey = l_partkey
        left join orders on o_orderkey = l_orderkey""",
    ),
    "recs": (
        ("slots",),
        """select rec_id, count(*) as n_slots,
            date_diff('day', min(shipdate), max(shipdate))::int as duration,
            round(sum(price) filter (slot < 5), 2) as t0_price,
            round(sum(price) filter (slot >= 5), 2) as t1_price
        from slots group by rec_id""",
    ),
    # Every slot of every record, filled with the field defaults.
    "grid": (
        ("slots", "recs"),
        """select r.rec_id, g.slot::int as slot, coalesce(brand, '') as brand, coalesce(ptype, '') as ptype,
            coalesce(priority, '') as priority, coalesce(psize, 26) as psize, coalesce(quantity, 25) as quantity,
            coalesce(price::float, 53054.271::float)::double as price,
            coalesce(discount::float, 0.05::float)::double as discount,
            coalesce(returnflag, 'R') as returnflag, coalesce(linestatus, 'O') as linestatus
        from recs r cross join range(10) g(slot)
        left join slots s on s.rec_id = r.rec_id and s.slot = g.slot""",
    ),
    "filled": (
        ("recs",),
        """select rec_id, duration, coalesce(t0_price::float, 264728.47::float)::double as t0_price,
            coalesce(t1_price::float, 264728.47::float)::double as t1_price,
            coalesce(t0_price > t1_price, false) as t0_win, coalesce(t1_price > t0_price, false) as t1_win
        from recs""",
    ),
    # Non-zero known columns.
    "nz": (
        ("grid",),
        f"""select rec_id, slot * 33 + list_position({BRAND_LIST}, brand) - 1 as pos from grid
        union all select rec_id, slot * 33 + 26 + list_position({TYPE_LIST}, ptype) - 1 from grid
        union all select rec_id, 330 + slot * 6 + list_position({PRIORITY_LIST}, priority) - 1 from grid""",
    ),
    # Encoded unknown columns, j = 0..562.
    "truth": (
        ("grid", "filled"),
        f"""select rec_id, slot * 56 as j, (psize > 25.619)::int::double as y from grid
        union all select rec_id, slot * 56 + k - 1, (quantity >= k)::int::double from grid cross join range(2, 51) t(k)
        union all select rec_id, slot * 56 + 50, ((price - 53054.271::double) / 30082.661::double)::float::double from grid
        union all select rec_id, slot * 56 + 51, ((discount - 0.05::double) / 0.029::double)::float::double from grid
        union all select rec_id, slot * 56 + 52 + k, ({FLAG_LIST}[k + 1] = returnflag)::int::double
            from grid cross join range(3) t(k)
        union all select rec_id, slot * 56 + 55, (linestatus = 'O')::int::double from grid
        union all select rec_id, 560, ((t0_price - 264728.47::double) / 67253.161::double)::float::double from filled
        union all select rec_id, 561, ((t1_price - 264728.47::double) / 67253.161::double)::float::double from filled
        union all select rec_id, 562, ((duration - 2043.684::double) / 277.555::double)::float::double from filled""",
    ),
    # What each unknown column belongs to.
    "lay": (
        (),
        """select j, slot, case when r = 0 then 'psize' when r < 50 then 'quantity' when r = 50 then 'price'
                when r = 51 then 'discount' when r < 55 then 'returnflag' when r = 55 then 'linestatus'
                when j = 562 then 'duration' else 'team_price' end as fam,
            case when r is not null then 'participants.' || slot || '.' || case when r = 0 then 'psize'
                when r < 50 then 'quantity' when r = 50 then 'price' when r = 51 then 'discount'
                when r < 55 then 'returnflag' else 'linestatus' end
                when j = 562 then 'duration' else 'teams.' || (j - 560) || '.price' end as field,
            case when r in (0, 55) then 'bool' when r < 50 then 'unary' when r in (50, 51) then 'continuous'
                when r is not null then 'one-hot' else 'continuous' end as handling,
            case when r = 0 then 14.478 when r < 50 then 14.432 when r = 50 then 30082.661 when r = 51 then 0.029
                when j = 562 then 277.555 when r is null then 67253.161 else 1.0 end::double as sd,
            case when r = 0 then 25.619 when r < 50 then 25.402 when r = 50 then 53054.271 when r = 51 then 0.05
                when j = 562 then 2043.684 when r is null then 264728.47 else 0.0 end::double as mean
        from (select j, case when j < 560 then j // 56 end as slot, case when j < 560 then j % 56 end as r
              from range(563) t(j)) q""",
    ),
    "hidden": (
        ("nz",),
        f"""select rec_id, list({leaky('v')} order by k) as h from (
            select rec_id, k, {bias('k', 10.0)} + sum({weight('pos', 'k', 10.0)}) as v
            from nz cross join range(8) t(k) group by rec_id, k) q group by rec_id""",
    ),
    "outw": (
        (),
        f"""select j, list({weight('k', 'j', 10.0)} order by k) as w, {last_bias('j', 10.0)} as b
        from range(563) t(j) cross join range(8) u(k) group by j""",
    ),
    "logits": (
        ("hidden", "outw"),
        "select rec_id, j, b + list_dot_product(h, w) as z from hidden cross join outw",
    ),
    "probs": (
        ("logits", "lay"),
        """select rec_id, j, case when handling = 'continuous' then z else 1 / (1 + exp(-z)) end as p
        from logits join lay using (j)""",
    ),
    # Decoded logits, one row per record and field.
    "decoded": (
        ("logits", "lay"),
        f"""select rec_id, field, any_value(slot) as slot, any_value(fam) as fam,
            case any_value(handling)
              when 'one-hot' then {FLAG_LIST}[(arg_max(j, (z, -j)) - any_value(slot) * 56 - 51)::int]
              when 'bool' then case when any_value(fam) = 'linestatus' then case when max(z) > 0 then 'O' else 'F' end end
            end as txt,
            case any_value(fam) when 'quantity' then count(*) filter (z > 0) + 1
              when 'psize' then case when max(z) > 0 then trunc(25.619 + 14.478) else trunc(25.619 - 14.478) end
              when 'duration' then trunc(least(greatest(max(z) * 277.555::double + 2043.684::double, 0), 65535))
              when 'price' then greatest(max(z) * 30082.661::double + 53054.271::double, 0)::float::double
              when 'discount' then greatest(max(z) * 0.029::double + 0.05::double, 0)::float::double
              when 'team_price' then greatest(max(z) * 67253.161::double + 264728.47::double, 0)::float::double
            end::double as num
        from logits join lay using (j) group by rec_id, field""",
    ),
    # Values of every declared field, long form.
    "cells": (
        ("slots", "recs"),
        "\n union all ".join(
            [
                unpivot("brand", "brand", "enum"),
                unpivot("ptype", "ptype", "enum"),
                unpivot("psize", "psize", "int"),
                unpivot("quantity", "quantity", "int"),
                unpivot("price", "price", "float"),
                unpivot("discount", "discount", "float"),
                unpivot("returnflag", "returnflag", "enum"),
                unpivot("linestatus", "linestatus", "enum"),
                "select 'teams.' || (slot // 5) || '.bans.' || (slot % 5) || '.priority', null::double, priority "
                "from slots where priority is not null",
                "select 'teams.0.price', t0_price, null::varchar from recs where t0_price is not null",
                "select 'teams.1.price', t1_price, null::varchar from recs where t1_price is not null",
                "select 'duration', duration::double, null::varchar from recs where duration is not null",
                "select 'teams.0.win', (t0_price > t1_price)::int::double, "
                "case when t0_price > t1_price then 'True' else 'False' end from recs where t1_price is not null",
                "select 'teams.1.win', (t1_price > t0_price)::int::double, "
                "case when t1_price > t0_price then 'True' else 'False' end from recs where t1_price is not null",
            ]
        ),
    ),
    "stats": (
        ("cells",),
        """select path, count(*) as n, avg(num) as mean, stddev_pop(num) as sd, min(num) as min, max(num) as max,
            median(num) as median, list_sort(list_distinct(list(txt))) as levels
        from cells group by path""",
    ),
    "devs": (
        ("cells", "stats"),
        "select path, avg(abs(num - mean)) as md from cells join stats using (path) group by path",
    ),
    "modes": (
        ("cells",),
        """select path, num as mode_num, txt as mode_txt from (
            select path, num, txt, row_number() over (partition by path order by count(*) desc, num, txt) as r
            from cells group by path, num, txt) q where r = 1""",
    ),
    # The measured dictionary: one row per field with text statistics.
    "dict": (
        ("stats", "devs", "modes"),
        """select line, path, fmt, case when kind = 'enum' then 'enum(' || array_to_string(levels, '|') || ')' else kind end as format,
            kind, handling, default_column, occurrence, portion, n, levels,
            case when kind <> 'enum' then mean::decimal(38,3)::varchar end as mean,
            case when kind <> 'enum' then sd::decimal(38,3)::varchar end as sd,
            case when kind <> 'enum' then md::decimal(38,3)::varchar end as md,
            case kind when 'int' then min::bigint::varchar when 'float' then min::decimal(38,3)::varchar
                when 'bool' then case when min > 0 then 'True' else 'False' end end as min,
            case kind when 'int' then max::bigint::varchar when 'float' then max::decimal(38,3)::varchar
                when 'bool' then case when max > 0 then 'True' else 'False' end end as max,
            case kind when 'int' then floor(median)::bigint::varchar when 'float' then median::decimal(38,3)::varchar end as median,
            case kind when 'int' then mode_num::bigint::varchar when 'float' then mode_num::decimal(38,3)::varchar
                else mode_txt end as mode
        from (
            select s.*, md, mode_num, mode_txt, fam as fmt,
              case fam when 'psize' then 'int' when 'quantity' then 'int' when 'duration' then 'int'
                when 'price' then 'float' when 'discount' then 'float' when 'win' then 'bool' else 'enum' end as kind,
              case fam when 'psize' then 'bool' when 'linestatus' then 'bool' when 'win' then 'bool'
                when 'quantity' then 'unary' when 'price' then 'continuous' when 'discount' then 'continuous'
                when 'duration' then 'continuous' else 'one-hot' end as handling,
              case fam when 'psize' then 'Median' when 'quantity' then 'Median' when 'price' then 'Mean'
                when 'discount' then 'Mean' when 'duration' then 'Mean' else 'Mode' end as default_column,
              case split_part(path, '.', 1) when 'participants' then 'per-participant' when 'teams' then 'per-team'
                else 'single' end as occurrence,
              case when fam in ('brand', 'ptype', 'priority') then 1 when fam = 'win' then 2 else 4 end as portion,
              case when path = 'duration' then 92
                when fam = 'win' then 93 + split_part(path, '.', 2)::int
                when path like 'teams.%.price' then 80 + split_part(path, '.', 2)::int * 6 + 5
                when fam = 'priority' then 80 + split_part(path, '.', 2)::int * 6 + split_part(path, '.', 4)::int
                else split_part(path, '.', 2)::int * 8 + list_position(
                    ['brand','ptype','psize','quantity','price','discount','returnflag','linestatus'], fam) - 1 end as line
            from (select *, regexp_extract(path, '[a-z]+$') as fam from stats) s
            left join devs using (path) left join modes using (path)) q""",
    ),
    # Encoded layout of the measured dictionary.
    "layout": (
        ("dict",),
        """select path, portion, handling, part_kind, part_key,
            row_number() over (order by case portion when 1 then 0 when 4 then 1 else 2 end, line, part) - 1 as pos, line
        from (
            select d.path, d.portion, d.handling, d.line, 'level' as part_kind, u.i as part,
                (case when portion = 1 then list_append(levels, '') else levels end)[u.i] as part_key
            from dict d, unnest(range(1, len(levels) + 1 + (portion = 1)::int)) u(i)
            where handling = 'one-hot'
            union all
            select d.path, d.portion, d.handling, d.line, 'number', u.i, u.i::varchar
            from dict d join (select fmt, min(min::int) as lo, max(max::int) as hi from dict where handling = 'unary'
                group by fmt) b using (fmt), unnest(range(b.lo + 1, b.hi + 1)) u(i)
            where handling = 'unary'
            union all
            select path, portion, handling, line, 'value', 0, null from dict where handling in ('bool', 'continuous')) q""",
    ),
    "win_in": (
        ("nz", "probs"),
        f"""select rec_id, k, sum(v) as v from (
            select rec_id, k, {weight('pos', 'k', 100.0)} as v from nz cross join range(8) t(k)
            union all
            select rec_id, k, list_dot_product(p, w) from (select rec_id, list(p order by j) as p from probs group by rec_id)
            cross join (select k, list({weight('j + 390', 'k', 100.0)} order by j) as w
                        from range(563) t(j) cross join range(8) u(k) group by k)
        ) q group by rec_id, k""",
    ),
    "win_logits": (
        ("win_in",),
        f"""select rec_id, {last_bias('0', 100.0)} + sum(({leaky('v')}) * {weight('k', '0', 100.0)}) as z
        from (select rec_id, k, v + {bias('k', 100.0)} as v from win_in) q group by rec_id""",
    ),
    "win_in_raw": (
        ("nz", "logits"),
        f"""select rec_id, k, sum(v) as v from (
            select rec_id, k, {weight('pos', 'k', 100.0)} as v from nz cross join range(8) t(k)
            union all
            select rec_id, k, list_dot_product(p, w) from (select rec_id, list(z order by j) as p from logits group by rec_id)
            cross join (select k, list({weight('j + 390', 'k', 100.0)} order by j) as w
                        from range(563) t(j) cross join range(8) u(k) group by k)
        ) q group by rec_id, k""",
    ),
    "win_logits_raw": (
        ("win_in_raw",),
        f"""select rec_id, {last_bias('0', 100.0)} + sum(({leaky('v')}) * {weight('k', '0', 100.0)}) as z
        from (select rec_id, k, v + {bias('k', 100.0)} as v from win_in_raw) q group by rec_id""",
    ),
    "placed": (
        ("recs",),
        "select rec_id, row_number() over (order by rec_id) - 1 as pos from recs",
    ),
    "log": (
        (),
        """select user_id as run, row_number() over (partition by user_id order by ts, event_id) as step,
            value as loss, value as accuracy, ts, event_id from events""",
    ),
}


def sql(select: str, *ctes: str, extra: dict[str, str] | None = None) -> str:
    """A query over the named building blocks, with what they depend on."""
    ordered: list[str] = []

    def visit(name: str):
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in ctes:
        visit(name)
    blocks = [f"{name} as materialized ({CTES[name][1]})" for name in ordered]
    blocks += [f"{name} as ({text})" for name, text in (extra or {}).items()]
    head = "with " + ",\n".join(blocks) + "\n" if blocks else ""
    return head + select
