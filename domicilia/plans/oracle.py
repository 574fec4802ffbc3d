"""SQL for the checking engine: one statement per registered query.

Written against the benchmark tables, apart from the DataFrame code; only the column
definitions of the survey stand-in and the fixed code lists are shared.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from domicilia.functions import codes
from domicilia.sources import standin

R, SEED, BUCKETS, SLACK = 20, 8888, 16, 6.0
T_CRITICAL = 2.093024054408263  # Student's t, 0.975, 19 degrees of freedom


def _fields(fields: Mapping[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in fields.items())


def _label(column: str, labels: Mapping) -> str:
    quoted = [f"WHEN {column} = {code!r} THEN '{label}'" for code, label in labels.items()]
    return "CASE " + " ".join(quoted) + " END"


def _clean(column: str, missing: Sequence[int], zero: Sequence[int]) -> str:
    missing_, zero_ = ", ".join(map(str, missing)), ", ".join(map(str, zero))
    return f"CASE WHEN {column} IN ({missing_}) THEN NULL WHEN {column} IN ({zero_}) THEN 0.0e0 ELSE {column} END"


_SORT = ", ".join(standin.RESIDENT_ORDER)
_GROUP_A = ["G16", "G19"]
_GROUP_B = ["G201", "G202", "G203", "G204"]
_PERSONAL = {c: _clean(c, [77777, 88888], [66666, 99999]) for c in _GROUP_A + _GROUP_B}
_SHARED = {c: _clean(c, [77777, 88888], [66666, 99999]) for c in _GROUP_A} | {
    c: _clean(c, [77777], [66666, 88888, 99999]) for c in _GROUP_B
}
_INDIVIDUAL = " + ".join(f"({sql})" for sql in _PERSONAL.values())
_IN_HOUSEHOLD = " + ".join(f"({sql})" for sql in _SHARED.values())

_GENDER = _label("E03", codes.GENDER)
_RACE = _label("E04", codes.RACE)
_JOB = (
    "CASE WHEN G13 = 3 AND G08 IN (1, 2, 4, 14, 15, 16) THEN 'informal'"
    " WHEN G08 IN (5, 6, 7, 8) AND G09 = 2 THEN 'informal' WHEN G13 = 88 THEN 'Não respondeu'"
    " WHEN G05 IN (4, 99) AND G041 <> 1 THEN 'Desempregado' WHEN G041 = 1 THEN 'Aposentado' ELSE 'formal' END"
)
_AGE = (
    "CASE WHEN idade_calculada BETWEEN 24 AND 29 THEN '24 a 29' WHEN idade_calculada BETWEEN 30 AND 39 THEN '30 a 39'"
    " WHEN idade_calculada BETWEEN 40 AND 64 THEN '40 a 64' END"
)


_VISIT_MONTH = _label("month(strptime(datavisita, '%m/%d/%Y'))", codes.MONTHS)


def _income_band(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 0 AND {x} <= 1800 THEN 'Até R$1800' WHEN {x} > 1800 AND {x} <= 2600 THEN 'Entre R$1801 e R$2600'"
        f" WHEN {x} > 2600 AND {x} <= 4000 THEN 'Entre R$2601 e R$4000' WHEN {x} > 4000 AND {x} <= 9000"
        f" THEN 'Entre R$4001 e R$9000' WHEN {x} > 9000 THEN 'Maior que R$9000' END"
    )


def _demand_class(x: str) -> str:
    arms = [f"WHEN {x} <= {limit} THEN '{label}'" for limit, label in zip(codes.DEMAND_LIMITS, codes.DEMAND_CLASSES)]
    return f"CASE {' '.join(arms)} WHEN {x} > 10000 THEN '+10000' END"


def _index_part(table: str, date: str, value: str, classe: int) -> str:
    return (
        f"SELECT {classe} AS classe, '2018' || lpad(cast(month({date}) AS VARCHAR), 2, '0') AS ref,"
        f" {_label(f'month({date})', codes.MONTHS)} || ' 2018' AS ref1, cast({value} AS DOUBLE) AS valor"
        f" FROM {table} GROUP BY month({date})"
    )


# Common table expressions by name; each may use the ones before it.
CTE = {
    "hh": f"SELECT {_fields(standin.DWELLING)} FROM orders JOIN customer ON o_custkey = c_custkey",
    "pes": (
        f"SELECT {_fields({**standin.RESIDENT, **standin.RELATION})} FROM (SELECT *, row_number() OVER"
        f" (PARTITION BY l_orderkey ORDER BY {_SORT}) = 1 AS head FROM lineitem)"
    ),
    "idx": (
        _index_part("lineitem", "l_shipdate", standin.INDEX_GENERAL, codes.GENERAL_INDEX)
        + " UNION ALL "
        + _index_part("orders", "o_orderdate", standin.INDEX_RENT, codes.RENT_INDEX)
    ),
    "per": (
        "SELECT *, cast(substr(ref, 6, 1) AS DOUBLE) AS mes_n, trim(regexp_replace(ref1, '[0-9]', '', 'g')) AS mes FROM idx"
    ),
    "infl": (
        "SELECT DISTINCT classe, mes, CASE WHEN mes = 'julho' THEN 1.0e0 ELSE f END AS inflator FROM ("
        "SELECT classe, mes, product(valor / 100 + 1) OVER (PARTITION BY classe ORDER BY ref DESC) AS f FROM per"
        " WHERE ref BETWEEN '201803' AND '201807' UNION ALL "
        "SELECT classe, mes, 1 / product(valor / 100 + 1) OVER (PARTITION BY classe ORDER BY ref) AS f FROM per"
        " WHERE ref BETWEEN '201807' AND '201810')"
    ),
    "months": (
        "SELECT mes, max(CASE WHEN classe = 7169 THEN inflator END) AS inflator_geral,"
        " max(CASE WHEN classe = 7448 THEN inflator END) AS inflator_aluguel FROM infl GROUP BY mes"
    ),
    "hm": (
        f"SELECT hh.*, m.mes, m.inflator_geral, m.inflator_aluguel FROM (SELECT *, {_VISIT_MONTH} AS mes FROM hh) hh"
        " LEFT JOIN months m USING (mes)"
    ),
    "renda": (
        "SELECT A01nficha, CASE WHEN count(x) = count(*) THEN sum(x) END AS renda_dom, count(*) AS pessoas,"
        " CASE WHEN count(x) = count(*) THEN sum(x) END / count(*) AS renda_pc"
        f" FROM (SELECT A01nficha, {_IN_HOUSEHOLD} AS x FROM pes WHERE E02 IS NULL OR E02 NOT IN (17, 18)) GROUP BY A01nficha"
    ),
    # Every sample row of the dwelling survey: dwellings with their residents, if any.
    "sample_d": (
        "SELECT hh.*, p.E21, p.A01nficha IS NOT NULL AS has FROM hh LEFT JOIN pes p"
        " ON hh.A01nficha = p.A01nficha AND hh.A01ra = p.A01ra"
    ),
    "sample_r": "SELECT hh.* FROM pes p JOIN hh ON hh.A01nficha = p.A01nficha",
}


def _design(kind: str) -> dict[str, str]:
    """Weights and replicate factors of the sample `sample_<kind>`."""
    s = f"sample_{kind}"
    steps, term = [], "1.0e0"
    for k in range(18):
        if k:
            term = f"{term} + pow(rate, {k}) / {_factorial(k)}.0e0"
        steps.append(f"exp(-rate) * ({term}) AS s{k}")
    count = " ".join(f"WHEN u < s{k} THEN {k}" for k in range(18))

    def stir(source: str, column: str, rest: str) -> str:
        once = f"(xor({column}, {column} >> 16) * 73244475) & 4294967295"
        inner = f"SELECT * REPLACE ({once} AS {column}) FROM ({source})"
        inner = f"SELECT * REPLACE ({once} AS {column}) FROM ({inner})"
        return f"SELECT * REPLACE (xor({column}, {column} >> 16) AS {column}){rest} FROM ({inner})"

    hexed = "('0x' || substr({}, {}, {}))::BIGINT"
    digest = f"md5('{SEED}:' || stratum || ':' || psu)"
    start = (
        f"SELECT stratum, psu, rep, ({hexed.format(digest, 1, 8)} + rep * 2654435761) & 4294967295 AS a,"
        f" {hexed.format(digest, 9, 8)} AS b FROM psu_{kind}, (SELECT unnest(range(1, {R + 1})) AS rep)"
    )
    stirred = stir(start, "a", "")
    stirred = stir(f"SELECT * REPLACE (xor(a, b) AS b) FROM ({stirred})", "b", "")
    drawn = f"md5('{SEED}:' || stratum || ':draw:' || rep || ':' || j)"
    return {
        f"w_{kind}": (
            f"SELECT A01nficha, A01setor, POS_ESTRATO, PESO_PRE * max(freq) / max(total) AS w, count(*) AS n_rows FROM {s}"
            f" JOIN (SELECT POS_ESTRATO, max(POP_AJUSTADA_PROJ) AS freq, sum(PESO_PRE) AS total FROM {s} GROUP BY 1)"
            " USING (POS_ESTRATO) GROUP BY A01nficha, A01setor, POS_ESTRATO, PESO_PRE"
        ),
        f"psu_{kind}": f"SELECT DISTINCT A01setor AS stratum, A01nficha AS psu FROM {s}",
        f"strata_{kind}": (
            f"SELECT *, {', '.join(steps)} FROM (SELECT stratum, count(*) AS n_h,"
            f" greatest(0, count(*) - 1 - {SLACK} * sqrt(count(*) - 1)) / count(*) AS rate FROM psu_{kind} GROUP BY stratum)"
        ),
        f"own_{kind}": (
            f"SELECT stratum, psu, rep, n_h, CASE {count} ELSE 18 END AS k FROM (SELECT *, (a * 1048576 + (b >> 12))"
            f" / 4503599627370496.0e0 AS u FROM ({stirred})) JOIN strata_{kind} USING (stratum)"
        ),
        f"fill_{kind}": (
            "SELECT stratum, rep, n_h, sum(k) <= n_h - 1 AS keep, CASE WHEN sum(k) <= n_h - 1 THEN n_h - 1 - sum(k)"
            f" ELSE n_h - 1 END AS m FROM own_{kind} GROUP BY stratum, rep, n_h"
        ),
        f"extra_{kind}": (
            f"SELECT stratum, rep, {hexed.format(drawn, 1, 15)} % n_h + 1 AS i, count(*) AS e FROM"
            f" (SELECT stratum, rep, n_h, unnest(range(0, m::BIGINT)) AS j FROM fill_{kind}) GROUP BY ALL"
        ),
        f"place_{kind}": (
            "SELECT stratum, psu, row_number() OVER (PARTITION BY stratum ORDER BY"
            f" {hexed.format('md5(psu::VARCHAR)', 1, 8)} % {BUCKETS}, psu) AS i FROM psu_{kind}"
        ),
        f"rep_{kind}": (
            "SELECT o.stratum, o.psu, o.rep, CASE WHEN o.n_h = 1 THEN 1.0e0 ELSE ((CASE WHEN f.keep THEN o.k ELSE 0 END)"
            f" + coalesce(e.e, 0)) * (o.n_h / (o.n_h - 1.0e0)) END AS factor FROM own_{kind} o"
            f" JOIN fill_{kind} f ON f.stratum = o.stratum AND f.rep = o.rep"
            f" JOIN place_{kind} p ON p.stratum = o.stratum AND p.psu = o.psu"
            f" LEFT JOIN extra_{kind} e ON e.stratum = o.stratum AND e.rep = o.rep AND e.i = p.i"
            f" UNION ALL SELECT stratum, psu, 0 AS rep, 1.0e0 FROM psu_{kind}"
        ),
    }


def _factorial(k: int) -> int:
    return 1 if k < 2 else k * _factorial(k - 1)


# Dwellings with one of them alone in a stratum of its own.
CTE["sample_l"] = "SELECT * REPLACE (CASE WHEN A01nficha = 0 THEN 1 ELSE A01setor END AS A01setor) FROM hh"
CTE |= _design("d") | _design("r") | _design("l")

_BURDEN = (
    "B03 = 3 AND B02 <> 3 AND B01 = 1 AND B05 * inflator_aluguel >= 0.3e0 * (renda_dom * inflator_geral)"
    " AND renda_dom * inflator_geral > 0 AND renda_dom * inflator_geral <= 2862"
    " AND (B05 IS NULL OR B05 NOT IN (77777, 88888))"
)


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _composition(arms: Sequence[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for c, label in arms) + " ELSE 'nenhum' END"


_ONLY = [
    ("p = 1 AND c = 1 AND o = 1 AND a = 1", "todos"),
    ("p = 1 AND c = 0 AND o = 0 AND a = 0", "Precariedade"),
    ("p = 0 AND c = 1 AND o = 0 AND a = 0", "coabitacao"),
    ("p = 0 AND c = 0 AND o = 1 AND a = 0", "onus"),
    ("p = 0 AND c = 0 AND o = 0 AND a = 1", "adensamento"),
]
_COMPOSITION = _composition(
    _ONLY
    + [
        ("c = 1 AND o = 1", "Coabitacao e onus"),
        ("c = 1 AND a = 1", "Coabitacao e adensamento"),
        ("o = 1 AND a = 1", "onus e adensamento"),
        ("p = 1 AND c = 1", "precariedade e coabitacao"),
        ("p = 1 AND o = 1", "precariedade e onus"),
        ("p = 1 AND a = 1", "precariedade e adensamento"),
    ]
)
_COMPOSITION_LEGACY = _composition(
    _ONLY
    + [
        ("p = 1 AND c = 1", "precariedade e coabitacao"),
        ("p = 1 AND (o = 1 OR a = 1)", "precariedade e onus"),
        ("c = 1 AND o = 1", "Coabitacao e onus"),
        ("c = 1 AND a = 1", "Coabitacao e adensamento"),
        ("o = 1 AND a = 1", "onus e adensamento"),
    ]
)
_DOMINANT = (
    "CASE WHEN composicao IN ('adensamento', 'Coabitacao e adensamento', 'onus e adensamento', 'precariedade e adensamento')"
    " THEN 'adensamento' WHEN composicao IN ('coabitacao', 'Coabitacao e onus', 'precariedade e coabitacao') THEN 'coabitacao'"
    " WHEN composicao IN ('onus', 'precariedade e onus') THEN 'onus' WHEN composicao = 'Precariedade' THEN 'Precariedade'"
    " ELSE 'sem deficit' END"
)

CTE |= {
    "wish": f"SELECT A01nficha, sum({_flag('E21 = 1')}) AS novo_dom FROM sample_d GROUP BY A01nficha",
    # Heads with weight, deficit flags and labels; `psu` and `stratum` link to the factors.
    "h0": (
        f"SELECT hm.*, p.E03, p.E04, {_GENDER} AS genero, {_RACE} AS raca, {_JOB} AS job, novo_dom, renda_dom, w.w,"
        f" {_label('hm.A01ra', codes.REGIONS)} AS RA_nome, hm.A01nficha AS psu, hm.A01setor AS stratum"
        " FROM hm JOIN pes p ON p.A01nficha = hm.A01nficha AND p.A01ra = hm.A01ra AND p.E02 = 1"
        " JOIN wish ON wish.A01nficha = hm.A01nficha JOIN w_d w ON w.A01nficha = hm.A01nficha"
        " LEFT JOIN renda ON renda.A01nficha = hm.A01nficha"
    ),
    "h1": (
        f"SELECT *, {_flag('B01 = 1 AND B08 >= 4 AND B02 <> 3')} AS dom_rust, {_flag('B01 = 2')} AS dom_imp,"
        f" {_flag('B01 = 1 AND A01nfamilias <> 1 AND novo_dom > 0')} AS fam_conv, {_flag('B02 = 3 AND B01 = 1')} AS comodo,"
        f" {_flag(_BURDEN)} AS onus_aluguel,"
        f" {_flag('B03 = 3 AND B01 = 1 AND (CASE WHEN B12 = 0 THEN A01npessoas > 0 ELSE A01npessoas / B12 > 3 END)')} AS adens"
        " FROM h0"
    ),
    "h2": (
        f"SELECT *, {_flag('dom_rust = 1 OR dom_imp = 1')} AS habit_prec,"
        f" {_flag('fam_conv = 1 OR comodo = 1')} AS cohabit_familiar FROM h1"
    ),
    "h": (
        f"SELECT *, {_flag('p = 1 OR c = 1 OR o = 1 OR a = 1')} AS deficit_habit, {_COMPOSITION} AS composicao,"
        f" {_COMPOSITION_LEGACY} AS composicao_antiga, CASE WHEN dom_rust = 1 THEN 'domicílio rústico' WHEN dom_imp = 1"
        " THEN 'domícílio improvisado' END AS domicilio, CASE WHEN fam_conv = 1 THEN 'Famílias conviventes'"
        f" WHEN comodo = 1 THEN 'Cômodo' ELSE 'Demais' END AS situacao, {_label('B06', codes.LOT_STATUS)} AS lote"
        " FROM (SELECT *, habit_prec AS p, cohabit_familiar AS c, onus_aluguel AS o, adens AS a FROM h2)"
    ),
    # Residents with weight, real income and bands.
    "people": (
        f"SELECT pr.*, {_GENDER} AS genero, {_RACE} AS raca, {_JOB} AS job, {_AGE} AS faixa_idade,"
        f" CASE WHEN E02 = 1 THEN 'Chefe' WHEN E02 <> 1 THEN 'não chefe' END AS situacao_chefia,"
        f" {_income_band('real')} AS faixa_renda_ind, {_label('A01ra', codes.REGIONS)} AS RA_nome FROM (SELECT p.*, w.w,"
        f" ({_INDIVIDUAL}) * hm.inflator_geral AS real, p.A01nficha AS psu, w.A01setor AS stratum, hm.B02"
        " FROM pes p JOIN hm ON hm.A01nficha = p.A01nficha JOIN w_r w ON w.A01nficha = p.A01nficha) pr"
    ),
}


def _with(last: str) -> str:
    """The statement with the expressions it needs."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    visit(last)
    parts = [
        f"{name} AS {'MATERIALIZED ' if name.startswith(('rep_', 'own_', 'w_', 'h')) else ''}({CTE[name]})" for name in needed
    ]
    return f"WITH {', '.join(parts)} {last}" if parts else last


def _rounded(sql: str, digits: int, columns: Sequence[str]) -> str:
    rounds = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({rounds}) FROM ({sql})"


def _replicate_totals(frame: str, by: Sequence[str], measures: Mapping[str, str], design: str, na_rm: bool = False) -> str:
    sums = []
    for name, x in measures.items():
        total = f"sum(w * factor * ({x}))"
        strict = total if na_rm or x == "1" else f"CASE WHEN count({x}) = count(*) THEN {total} END"
        sums.append(f'{strict} AS "{name}"')
    keys = ", ".join([*by, "rep"])
    return f"SELECT {keys}, {', '.join(sums)} FROM ({frame}) f JOIN rep_{design} USING (stratum, psu) GROUP BY {keys}"


def _rolled(totals: str, by: Sequence[str], names: Sequence[str]) -> str:
    """The totals, those of their outer groups and the grand total."""
    parts = []
    for n in range(len(by), -1, -1):
        keys = [f"cast({c} AS VARCHAR) AS {c}" if i < n else f"'DF' AS {c}" for i, c in enumerate(by)]
        sums = ", ".join(f'sum("{x}") AS "{x}"' for x in names)
        grouping = ", ".join([*by[:n], "rep"])
        parts.append(f"SELECT {', '.join([*keys, 'rep'])}, {sums} FROM tot GROUP BY {grouping}")
    return f"WITH tot AS ({totals}) {' UNION ALL '.join(parts)}"


def _estimates(values: str, by: Sequence[str], names: Sequence[str], vartype: Sequence[str], digits: int) -> str:
    out = list(by)
    for n in names:
        value = f'max(CASE WHEN rep = 0 THEN "{n}" END)'
        error = f'stddev_samp(CASE WHEN rep > 0 THEN "{n}" END)'
        out.append(f'round({value}, {digits}) AS "{n}"')
        if "se" in vartype:
            out.append(f'round({error}, {digits}) AS "{n}_se"')
        if "cv" in vartype:
            out.append(f'round({error} / nullif({value}, 0), {digits}) AS "{n}_cv"')
        if "ci" in vartype:
            out.append(f'round({value} - {T_CRITICAL} * {error}, {digits}) AS "{n}_low"')
            out.append(f'round({value} + {T_CRITICAL} * {error}, {digits}) AS "{n}_upp"')
    grouping = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {', '.join(out)} FROM ({values}){grouping}"


def _total(
    frame: str,
    by: Sequence[str],
    measures: Mapping[str, str],
    vartype: Sequence[str] = ("se",),
    rollup: bool = False,
    design: str = "d",
    digits: int = 4,
    na_rm: bool = False,
) -> str:
    totals = _replicate_totals(frame, by, measures, design, na_rm)
    if rollup:
        totals = _rolled(totals, by, list(measures))
    return _estimates(totals, by, list(measures), vartype, digits)


def _mean(frame: str, by: Sequence[str], measures: Mapping[str, str], vartype: Sequence[str], rollup: bool = False) -> str:
    totals = _replicate_totals(frame, by, {**measures, "_size": "1"}, "d")
    if rollup:
        totals = _rolled(totals, by, [*measures, "_size"])
    ratios = ", ".join(f'"{n}" / nullif(_size, 0) AS "{n}"' for n in measures)
    return _estimates(f"SELECT {', '.join([*by, 'rep'])}, {ratios} FROM ({totals})", by, list(measures), vartype, 6)


def _share(frame: str, outer: Sequence[str], inner: str, name: str, vartype: Sequence[str]) -> str:
    totals = _replicate_totals(frame, [*outer, inner], {"t": "1"}, "d")
    parent = f"sum(t) OVER (PARTITION BY {', '.join([*outer, 'rep'])})"
    values = f"SELECT {', '.join([*outer, inner, 'rep'])}, t / nullif({parent}, 0) AS {name} FROM ({totals})"
    return _estimates(values, [*outer, inner], [name], vartype, 6)


def _wide(sql: str, rows: Sequence[str], key: str, value: str, names: Mapping[str, str], fill: bool = True) -> str:
    """Long to wide; `names` maps a condition value (as SQL) to the column name."""
    cells = []
    for literal, name in names.items():
        cell = f"max(CASE WHEN {key} = {literal} THEN {value} END)"
        cells.append(f'{f"coalesce({cell}, 0)" if fill else cell} AS "{name}"')
    return f"SELECT {', '.join([*rows, *cells])} FROM ({sql}) GROUP BY {', '.join(rows)}"


_H = "SELECT * FROM h"
_RENT = (
    "SELECT * FROM h WHERE renda_dom * inflator_geral > 0 AND renda_dom * inflator_geral <= 2862"
    " AND (B05 IS NULL OR B05 NOT IN (77777, 88888))"
)
_KINDS = {"'domícílio improvisado'": "domícílio improvisado", "'domicílio rústico'": "domicílio rústico"}
_PRECARIOUS_SUM = '"domícílio improvisado" + "domicílio rústico" AS "habitação precária"'
_COHABITING = {
    "'Cômodo'": "Cômodo",
    "'Famílias conviventes'": "Famílias conviventes",
    "'Demais'": "Demais",
}

_ADULTS = "SELECT * FROM people WHERE real IS NOT NULL AND idade_calculada BETWEEN 24 AND 64"
_ELIGIBLE = (
    "SELECT * FROM people WHERE real IS NOT NULL AND idade_calculada >= 24 AND idade_calculada < 65"
    " AND E02 <> 1 AND E02 <> 2 AND E02 <> 3"
)
_RATE = (
    "SELECT faixa_idade, sum(CASE WHEN situacao_chefia = 'Chefe' THEN w END) AS chefe,"
    f" sum(CASE WHEN situacao_chefia = 'não chefe' THEN w END) AS outro FROM ({_ADULTS}) GROUP BY faixa_idade"
)
_CELLS = (
    "SELECT RA_nome, faixa_renda_ind, faixa_idade, raca, genero, job, pop, chefe / (chefe + outro) AS taxadechefia,"
    " pop * (chefe / (chefe + outro)) AS dhde FROM (SELECT RA_nome, faixa_renda_ind, faixa_idade, raca, genero, job,"
    f" sum(w) AS pop FROM ({_ELIGIBLE}) GROUP BY ALL) LEFT JOIN ({_RATE}) USING (faixa_idade)"
)
_BANDS = (
    "SELECT r.RA_nome, b.faixa_renda_ind, coalesce(sum(dhde), 0) AS dhde FROM"
    f" (SELECT DISTINCT RA_nome FROM ({_CELLS})) r CROSS JOIN (SELECT unnest({codes.INCOME_BANDS!r}) AS faixa_renda_ind) b"
    f" LEFT JOIN ({_CELLS}) c ON c.RA_nome IS NOT DISTINCT FROM r.RA_nome AND c.faixa_renda_ind = b.faixa_renda_ind GROUP BY ALL"
)

_AREAS = f"SELECT {_fields(standin.OCCUPIED)} FROM orders"
_YEARS = [str(y) for y in standin.OCCUPIED_YEARS]
_AREA_CELLS = (
    "SELECT r.ra_cira, y.ano, coalesce(sum(area_1), 0) AS n FROM (SELECT DISTINCT ra_cira FROM ({a})) r"
    " CROSS JOIN (SELECT unnest({y}) AS ano) y LEFT JOIN ({a}) a ON a.ra_cira = r.ra_cira AND cast(a.ano AS VARCHAR) = y.ano"
    " GROUP BY ALL"
).format(a=_AREAS, y=_YEARS)
_AREA_RUNNING = f"SELECT ra_cira, ano, n, sum(n) OVER (PARTITION BY ra_cira ORDER BY ano ROWS UNBOUNDED PRECEDING) AS csum FROM ({_AREA_CELLS})"
_POLYGONS = (
    f"SELECT cast(k AS VARCHAR) AS ra_cira, 'RA-' || k AS ra_codigo, {_label('k', codes.REGIONS)} AS nome, cast(k AS VARCHAR) AS ra_num,"
    f" cast(1000 + n % 1000 AS DOUBLE) AS area FROM (SELECT {standin.DWELLING['A01ra']} AS k, count(*) AS n FROM orders GROUP BY 1)"
)
_POPULATION = _total("SELECT * FROM people", ["A01ra"], {"n": "1"}, ["ci"], design="r")
_TYPES = (
    "SELECT A01ra, round_even(sum(CASE WHEN B02 IN (1, 3, 4) THEN w END), 0) AS flat,"
    " round_even(sum(CASE WHEN B02 = 2 THEN w END), 0) AS house FROM people WHERE E02 = 1 GROUP BY A01ra"
)
_FLAT = "Apartamento+quitinete+cômodo"


def _polygon_sql() -> str:
    """Rectangles with an optional hole, measured by the rectangle formulas."""
    box = {}
    for ring, text in standin.VERTEX_RINGS.items():
        x, y, width, height = [f"({part.strip()})" for part in text.split(",")]
        box[ring] = {"a": f"{width} * {height}", "cx": f"({x} + {width} / 2.0e0)", "cy": f"({y} + {height} / 2.0e0)"}
    hole = "(c_custkey % 7 = 0)::INT"
    area = f"({box[0]['a']} - {hole} * {box[1]['a']})"
    centre = {
        axis: f"({box[0]['a']} * {box[0]['c' + axis]} - {hole} * {box[1]['a']} * {box[1]['c' + axis]}) / {area}"
        for axis in ("x", "y")
    }
    return (
        f"SELECT c_custkey AS poly_id, round(cast({area} AS DOUBLE), 4) AS area, round({centre['x']}, 4) AS x,"
        f" round({centre['y']}, 4) AS y FROM customer"
    )


def _parcel_sql() -> str:
    """Regions of grid parcels: area by count, borders by looking at the four neighbours of each."""
    width, height = standin.PARCEL_SIZE
    cells = (
        f"SELECT {standin.PARCEL['c']} AS c, {standin.PARCEL['r']} AS r, {standin.PARCEL_REGION} AS g FROM customer WHERE {standin.PARCEL_KEPT}"
    )
    sides = ((1, 0, height), (-1, 0, height), (0, 1, width), (0, -1, width))
    borders = " UNION ALL ".join(
        f"SELECT a.g, {length} AS length FROM p a LEFT JOIN p b ON b.c = a.c + {dc} AND b.r = a.r + {dr} AND b.g = a.g WHERE b.g IS NULL"
        for dc, dr, length in sides
    )
    return (
        f"WITH p AS ({cells}), b AS ({borders}) SELECT g AS ra_cira, n * {width * height} AS area, perimeter, n_edges, n_edges AS n_vertices,"
        f" n * {width * height} AS ring_area FROM (SELECT g, count(*) AS n FROM p GROUP BY g)"
        " JOIN (SELECT g, cast(sum(length) AS DOUBLE) AS perimeter, count(*) AS n_edges FROM b GROUP BY g) USING (g)"
    )


def _sketch_sql() -> str:
    w, h = standin.SKETCH_WIDTH, standin.SKETCH_HEIGHT
    kind = f"c_custkey % {len(standin.SKETCHES)}"
    cases = lambda *values: f"CASE {kind} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
    area = f"cast({cases(f'{w} * {h} / 2.0e0', f'{w} * {h} - 9', f'{w} * {h} - 20', f'{w} * {h}')} AS DOUBLE)"
    return (
        f"SELECT c_custkey AS poly_id, {area} AS area, {area} AS ring_area, {cases(6, 8, 8, 4)}::BIGINT AS n_vertices,"
        f" {cases(2, 1, 2, 1)}::BIGINT AS n_rings, {cases(0, 0, 1, 0)}::BIGINT AS n_holes FROM customer"
    )


# Linearised variances: every PSU of the sample has a value in every domain.
CTE |= {
    "sample_z": (
        "SELECT s.*, w.w, CASE WHEN s.A01nficha % 500 = 0 THEN -s.A01nficha - 1 ELSE s.A01setor END AS stratum, s.A01nficha AS psu"
        " FROM sample_d s JOIN w_d w ON w.A01nficha = s.A01nficha"
    ),
    "psu_z": "SELECT stratum, psu, POS_ESTRATO AS post, sum(w) AS w FROM sample_z GROUP BY ALL",
    "strata_z": "SELECT stratum, count(*) AS n_h FROM (SELECT DISTINCT stratum, psu FROM psu_z) GROUP BY stratum",
    "post_z": "SELECT post, sum(w) AS size FROM psu_z GROUP BY post",
}


def _linearised(values: str, policy: str = "adjust") -> str:
    """(domain, variance) of the sums of u over `values` (domain, psu, post, u), u weighted."""
    lone = {
        "adjust": "power(z - (sum(z) OVER (PARTITION BY domain)) / (count(*) OVER (PARTITION BY domain)), 2)",
        "average": "NULL",
        "remove": "0",
    }[policy]
    scaled = "sum(v) * count(DISTINCT stratum) / count(DISTINCT CASE WHEN n_h > 1 THEN stratum END)" if policy == "average" else "sum(v)"
    return (
        f"SELECT domain, {scaled} AS variance FROM (SELECT domain, stratum, n_h, CASE WHEN n_h > 1 THEN"
        " power(z - avg(z) OVER (PARTITION BY domain, stratum), 2) * n_h / (n_h - 1.0e0)"
        f" ELSE {lone} END AS v FROM (SELECT m.domain, p.stratum, p.psu, any_value(s.n_h) AS n_h,"
        " coalesce(sum(x.u), 0) - sum(p.w * m.mean) AS z FROM psu_z p"
        f" CROSS JOIN (SELECT d.domain, q.post, coalesce(sum(y.u), 0) / any_value(q.size) AS mean FROM (SELECT DISTINCT domain FROM ({values})) d"
        f" CROSS JOIN post_z q LEFT JOIN ({values}) y ON y.domain IS NOT DISTINCT FROM d.domain AND y.post = q.post GROUP BY ALL) m"
        f" LEFT JOIN (SELECT domain, psu, post, sum(u) AS u FROM ({values}) GROUP BY ALL) x"
        " ON x.domain IS NOT DISTINCT FROM m.domain AND x.psu = p.psu AND x.post = p.post"
        " JOIN strata_z s ON s.stratum = p.stratum WHERE m.post = p.post GROUP BY m.domain, p.stratum, p.psu)) GROUP BY domain"
    )


_ROLLED_HEADS = "SELECT * FROM h UNION ALL SELECT * REPLACE ('DF' AS RA_nome) FROM h"


def _linear_total(x: str) -> str:
    values = f"SELECT RA_nome AS domain, psu, POS_ESTRATO AS post, w * {x} AS u FROM ({_ROLLED_HEADS})"
    return (
        f"SELECT RA_nome, sum(w * {x}) AS est, sqrt(max(variance)) AS se FROM ({_ROLLED_HEADS}) f"
        f" JOIN ({_linearised(values)}) v ON v.domain IS NOT DISTINCT FROM f.RA_nome GROUP BY RA_nome"
    )


def _linear_queries() -> dict[str, str]:
    mean = f"SELECT RA_nome, sum(w * adens) / sum(w) AS adens, sum(w) AS size FROM ({_ROLLED_HEADS}) GROUP BY RA_nome"
    mean_values = (
        f"SELECT f.RA_nome AS domain, psu, POS_ESTRATO AS post, w * (f.adens - m.adens) / m.size AS u FROM ({_ROLLED_HEADS}) f"
        f" JOIN ({mean}) m ON m.RA_nome IS NOT DISTINCT FROM f.RA_nome"
    )
    share = "SELECT RA_nome, B02, sum(w) / sum(sum(w)) OVER (PARTITION BY RA_nome) AS pct, sum(sum(w)) OVER (PARTITION BY RA_nome) AS size FROM h GROUP BY RA_nome, B02"
    share_values = (
        "SELECT m.RA_nome || ':' || m.B02 AS domain, psu, POS_ESTRATO AS post, w * ((h.B02 = m.B02)::INT - m.pct) / m.size AS u"
        f" FROM h JOIN ({share}) m ON m.RA_nome = h.RA_nome"
    )
    one = "SELECT 1 AS domain, psu, POS_ESTRATO AS post, w * adens AS u FROM h"
    return {
        "linearised_total": (
            "SELECT a.RA_nome, " + ", ".join(
                f"round({t}.est, 4) AS {c}, round({t}.se, 4) AS {c}_se, round({t}.se / nullif({t}.est, 0), 4) AS {c}_cv"
                for t, c in (("a", "pessoas"), ("b", "adens"))
            )
            + f" FROM ({_linear_total('A01npessoas')}) a JOIN ({_linear_total('adens')}) b ON a.RA_nome IS NOT DISTINCT FROM b.RA_nome"
        ),
        "linearised_mean": (
            f"SELECT RA_nome, round(adens, 6) AS adens, round(sqrt(variance), 6) AS adens_se FROM ({mean}) m"
            f" JOIN ({_linearised(mean_values)}) v ON v.domain IS NOT DISTINCT FROM m.RA_nome"
        ),
        "linearised_share": (
            f"SELECT RA_nome, B02, round(pct, 6) AS pct, round(sqrt(variance), 6) AS pct_se FROM ({share}) m"
            f" JOIN ({_linearised(share_values)}) v ON v.domain = m.RA_nome || ':' || m.B02"
        ),
        "linearised_policies": " UNION ALL ".join(
            f"SELECT round((SELECT sum(w * adens) FROM h), 4) AS adens, round(sqrt(variance), 4) AS adens_se, '{policy}' AS regra"
            f" FROM ({_linearised(one, policy)})"
            for policy in ("adjust", "average", "remove")
        ),
    }


def _queries() -> dict[str, str]:
    sector = _label("A01setor", codes.SECTORS)
    region = _label("A01ra", codes.REGIONS)
    flags3 = {c: c for c in ("dom_rust", "dom_imp", "habit_prec")}
    coab3 = {c: c for c in ("fam_conv", "comodo", "cohabit_familiar")}
    n = {"n": "1"}
    cells = ["RA_nome", "genero", "raca", "job"]
    precarious = _total(_H, ["RA_nome", "domicilio"], n, [])
    cohabitation = _total(_H, ["RA_nome", "situacao"], n, ["ci"])
    precarious_share = f"SELECT * FROM ({_share(_H, ['RA_nome'], 'domicilio', 'pct', ['cv'])}) WHERE domicilio IS NOT NULL"
    long_coab = _total(_H, ["RA_nome", "job", "genero", "raca"], {c: c for c in ("fam_conv", "comodo")}, [])
    final = (
        f"SELECT a.*, b.* EXCLUDE (RA_nome) FROM ({_total(_H, ['RA_nome'], {c: c for c in ('habit_prec', 'adens', 'cohabit_familiar')}, ['cv'], True)}) a"
        f" LEFT JOIN ({_total(_RENT, ['RA_nome'], {'onus_aluguel': 'onus_aluguel'}, ['cv'], True)}) b"
        " ON a.RA_nome IS NOT DISTINCT FROM b.RA_nome"
    )
    composition = f"SELECT * FROM ({_total(_H, ['RA_nome', 'composicao'], n, ['ci'])}) WHERE composicao <> 'nenhum'"
    legacy = (
        f"SELECT RA_nome, composicao_antiga AS composicao, n, n_low, n_upp FROM"
        f" ({_total(_H, ['RA_nome', 'composicao_antiga'], n, ['ci'])}) WHERE composicao_antiga <> 'nenhum'"
    )
    dominant = f"SELECT *, {_DOMINANT} AS dominante FROM h"
    labels = ["todos", *codes.SINGLE_LABELS.values(), *[p[2] for p in codes.PAIR_LABELS]]
    path = "coalesce(cast({0} AS VARCHAR), 'NA') || '-' || coalesce(genero, 'NA') || '-' || coalesce(job, 'NA') || '-' || coalesce(raca, 'NA')"
    hierarchies = " UNION ALL ".join(
        f"SELECT {path.format(c)} AS hierarquia, n, n_low, n_upp, '{c}' AS componente FROM"
        f" ({_total(_H, [c, 'genero', 'job', 'raca'], n, ['ci'])}) WHERE {c} <> 0"
        for c in ("habit_prec", "cohabit_familiar", "onus_aluguel", "adens")
    )
    repost_sizes = (
        "SELECT POS_ESTRATO, rep, sum(w * n_rows * factor) AS s FROM (SELECT *, A01setor AS stratum, A01nficha AS psu FROM w_d)"
        " JOIN rep_d USING (stratum, psu) GROUP BY ALL"
    )
    repost = (
        f"SELECT RA_nome, t.rep, sum(n * z.s / g.s) AS n FROM ({_replicate_totals(_H, ['RA_nome', 'POS_ESTRATO'], n, 'd')}) t"
        f" JOIN ({repost_sizes}) g ON g.POS_ESTRATO = t.POS_ESTRATO AND g.rep = t.rep"
        f" JOIN (SELECT POS_ESTRATO, s FROM ({repost_sizes}) WHERE rep = 0) z ON z.POS_ESTRATO = t.POS_ESTRATO GROUP BY ALL"
    )
    strict = _total(_H, ["A01setor", "B08"], {"aluguel": "B05"}, ["se"])
    skipping = _total(_H, ["A01setor", "B08"], {"aluguel_conhecido": "coalesce(B05, 0)"}, ["se"])
    known = "SELECT A01setor, B08 FROM h GROUP BY ALL HAVING count(B05) > 0"
    rent_share = (
        f"SELECT a.*, b.pct_renda_baixa, b.pct_renda_baixa_cv FROM ({_mean(_H, ['RA_nome'], {'pct_domicilios': 'onus_aluguel'}, ['cv'])}) a"
        f" LEFT JOIN (SELECT * FROM ({_share(_RENT, ['RA_nome'], 'onus_aluguel', 'pct_renda_baixa', ['cv'])}) WHERE onus_aluguel = 1) b"
        " ON a.RA_nome IS NOT DISTINCT FROM b.RA_nome"
    )
    demand_by_band = f"SELECT RA_nome, faixa_renda_ind, round(dhde, 4) AS dhde FROM ({_BANDS})"
    return {
        "index_extract": "SELECT classe, ref, ref1, round(valor, 8) AS valor FROM idx",
        "recode_region": f"SELECT A01nficha, A01ra, {region} AS RA_nome FROM hh",
        "recode_sector": f"SELECT A01nficha, A01setor, {sector} AS ra_setor FROM hh",
        "project_columns": "SELECT A01nficha, idade_calculada, G201, G202, G203, G204 FROM pes",
        "rename_columns": "SELECT A01nficha AS ficha, A01npessoas AS n_pessoas, A01nfamilias AS n_familias FROM hh",
        "derive_columns": 'SELECT A01nficha, PESO_PRE, B12, 1 AS "count", PESO_PRE * B12 AS peso_quartos FROM hh',
        "round_numeric": "SELECT A01nficha, cast(round_even(B05, 0) AS DOUBLE) AS B05 FROM hh",
        "filter_heads": "SELECT A01nficha, E03, E04 FROM pes WHERE E02 = 1",
        "filter_age_range": "SELECT A01nficha, idade_calculada FROM pes WHERE idade_calculada >= 24 AND idade_calculada <= 64",
        "filter_not_in": "SELECT A01nficha, E02, round(G16, 4) AS G16 FROM pes WHERE E02 IS NULL OR E02 NOT IN (17, 18)",
        "filter_not_null": "SELECT A01nficha, round(B05, 4) AS B05 FROM hh WHERE B05 IS NOT NULL",
        "filter_not_equal": "SELECT A01nficha, E02 FROM pes WHERE E02 NOT IN (1, 2, 3)",
        "case_labels": (
            "SELECT A01nficha, CASE WHEN B01 = 1 AND B08 >= 4 AND B02 <> 3 THEN 'domicílio rústico'"
            " WHEN B01 = 2 THEN 'domícílio improvisado' END AS domicilio FROM hh"
        ),
        "bin_right_closed": f"SELECT A01nficha, {_demand_class('(B05 * 10)')} AS classe FROM hh",
        "recode_labels": f"SELECT ra_cira, nome AS ra, area FROM ({_POLYGONS})",
        "scalar_strings": "SELECT classe, ref, mes_n, mes FROM per",
        "scalar_casts": (
            "SELECT A01nficha, cast(A01ra AS VARCHAR) AS ra_texto, try_cast(POS_ESTRATO AS DOUBLE) AS estrato_numero,"
            " try_cast(split_part(datavisita, '/', 1) AS DOUBLE) AS mes_numero FROM hh"
        ),
        "visit_month": f"SELECT A01nficha, cast(strptime(datavisita, '%m/%d/%Y') AS DATE) AS data, {_VISIT_MONTH} AS mes FROM hh",
        "label_concat": (
            f"SELECT {region} || ' ' || cast(cast(sum(PESO_PRE) AS BIGINT) AS VARCHAR) AS rotulo FROM hh GROUP BY A01ra"
        ),
        "join_person_household": (
            "SELECT p.A01nficha, p.A01ra, E02, idade_calculada, p.FATOR_PROJ, B01, B02, POS_ESTRATO FROM pes p LEFT JOIN hh"
            " ON p.A01nficha = hh.A01nficha"
        ),
        "join_household_person": (
            "SELECT hh.A01nficha, hh.A01ra, B01, B02, POS_ESTRATO, hh.FATOR_PROJ, idade_calculada, E21 FROM hh LEFT JOIN pes p"
            " ON p.A01nficha = hh.A01nficha AND p.A01ra = hh.A01ra"
        ),
        "join_inflator": (
            f"SELECT A01nficha, {_VISIT_MONTH} AS mes, round(inflator_geral, 8) AS inflator_geral,"
            " round(inflator_aluguel, 8) AS inflator_aluguel FROM hm"
        ),
        "join_household_income": (
            "SELECT hh.A01nficha, A01ra, round(renda_dom, 8) AS renda_dom, pessoas, round(renda_pc, 8) AS renda_pc"
            " FROM hh LEFT JOIN renda ON renda.A01nficha = hh.A01nficha"
        ),
        "join_null_safe_natural": (
            "SELECT l.A01nficha, l.E02, l.idade_calculada, round(r.renda_individual, 4) AS renda_individual, count(*) AS copies"
            f" FROM pes l LEFT JOIN (SELECT A01nficha, E02, idade_calculada, {_INDIVIDUAL} AS renda_individual FROM pes) r"
            " ON l.A01nficha = r.A01nficha AND l.E02 IS NOT DISTINCT FROM r.E02 AND l.idade_calculada = r.idade_calculada"
            " GROUP BY l.A01nficha, l.E02, l.idade_calculada, r.renda_individual"
        ),
        "group_sum": "SELECT POS_ESTRATO, B01, sum(PESO_PRE) AS peso FROM hh GROUP BY POS_ESTRATO, B01",
        "strict_sum": (
            "SELECT A01nficha, CASE WHEN bool_or(x IS NULL) THEN NULL ELSE round(sum(x), 4) END AS g16 FROM"
            f" (SELECT A01nficha, {_PERSONAL['G16']} AS x FROM pes) GROUP BY A01nficha"
        ),
        "dissolve_sum": f"SELECT ra_cira, ano, round(sum(area_1), 4) AS n FROM ({_AREAS}) GROUP BY ra_cira, ano",
        "poststratum_population": (
            "SELECT POS_ESTRATO, max(POP_AJUSTADA_PROJ) AS freq, sum(PESO_PRE) AS weight_sum FROM hh GROUP BY POS_ESTRATO"
        ),
        "distinct_rows": "SELECT DISTINCT A01ra, E03, E04, G05, G08 FROM pes",
        "rollup_total": (
            "SELECT CASE WHEN grouping(RA_nome) = 1 THEN 'DF' ELSE RA_nome END AS RA_nome, sum(PESO_PRE) AS peso,"
            f" count(*) AS n FROM (SELECT *, {region} AS RA_nome FROM hh) t GROUP BY ROLLUP (RA_nome)"
        ),
        "window_partition_sum": (
            "SELECT A01nficha, E21, idade_calculada, sum(CASE WHEN E21 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY A01nficha)"
            "::BIGINT AS novo_dom FROM pes"
        ),
        "running_product": (
            "SELECT classe, ref, round(product(valor / 100 + 1) OVER (PARTITION BY classe ORDER BY ref DESC), 8) AS produto FROM idx"
        ),
        "running_sum": f"SELECT ra_cira, ano, round(n, 4) AS n, round(csum, 4) AS csum FROM ({_AREA_RUNNING})",
        "order_by_stat": (
            "SELECT RA_nome, n, cast(dense_rank() OVER (ORDER BY n) AS INT) AS rank FROM"
            f" (SELECT {region} AS RA_nome, sum(PESO_PRE) AS n FROM hh GROUP BY 1)"
        ),
        "order_by_group_sum": (
            "SELECT RA_nome, B02, n, cast(dense_rank() OVER (ORDER BY t DESC) AS INT) AS rank FROM (SELECT *, sum(n) OVER"
            f" (PARTITION BY RA_nome) AS t FROM (SELECT {region} AS RA_nome, B02, sum(PESO_PRE) AS n FROM hh GROUP BY 1, 2))"
        ),
        "union_by_name": "SELECT A01nficha, A01ra, B01 FROM hh UNION ALL BY NAME SELECT E21, A01ra, A01nficha FROM pes",
        "pivot_spread": (
            "SELECT A01ra, "
            + ", ".join(f"sum(CASE WHEN B02 = {k} THEN PESO_PRE END) AS b02_{k}" for k in range(1, 5))
            + " FROM hh GROUP BY A01ra"
        ),
        "unpivot_gather": " UNION ALL ".join(
            f"SELECT A01nficha, '{c}' AS variavel, {c} AS valor FROM hh" for c in ("B08", "B12", "A01npessoas")
        ),
        "pivot_complete_zero": f"SELECT ra_cira, ano, round(n, 4) AS n FROM ({_AREA_CELLS})",
        "complete_open_keys": (
            "SELECT r.ra_cira, y.ano, round(coalesce(sum(area_1), 0), 4) AS n FROM (SELECT DISTINCT ra_cira FROM ({a})) r"
            " CROSS JOIN (SELECT DISTINCT ano FROM ({a})) y LEFT JOIN ({a}) a ON a.ra_cira = r.ra_cira AND a.ano = y.ano GROUP BY ALL"
        ).format(a=_AREAS),
        "pivot_open_keys": _rounded(
            _wide(f"SELECT ra_cira, ano, sum(area_1) AS n FROM ({_AREAS}) GROUP BY ALL", ["ra_cira"], "ano", "n", {y: y for y in _YEARS}),
            4,
            _YEARS,
        ),
        "pivot_null_key": _wide(
            f"SELECT RA_nome, coalesce(domicilio, 'demais domicílios') AS domicilio, n FROM ({precarious})",
            ["RA_nome"],
            "domicilio",
            "n",
            {**_KINDS, "'demais domicílios'": "demais domicílios"},
        ),
        "split_fixed": (
            "SELECT ra_codigo, split_part(ra_codigo, '-', 1) AS ant,"
            f" substr(ra_codigo, strpos(ra_codigo, '-') + 1) AS code FROM ({_POLYGONS})"
        ),
        "polygon_centroid": _polygon_sql(),
        "dissolved_regions": _parcel_sql(),
        "repaired_polygons": _sketch_sql(),
        "design_summary": (
            "SELECT A01setor, count(DISTINCT A01nficha) AS n_psu, count(*) AS n_rows, sum(PESO_PRE) AS weight_sum FROM hh GROUP BY A01setor"
        ),
        "post_stratify": (
            "SELECT A01nficha, POS_ESTRATO, round(PESO_PRE * freq / total, 6) AS w FROM hh JOIN (SELECT POS_ESTRATO,"
            " max(POP_AJUSTADA_PROJ) AS freq, sum(PESO_PRE) AS total FROM hh GROUP BY 1) USING (POS_ESTRATO)"
        ),
        "bootstrap_factors": (
            "SELECT stratum AS A01setor, psu AS A01nficha, cast(rep AS INT) AS rep, round(factor, 8) AS factor FROM rep_d WHERE rep > 0"
        ),
        "bootstrap_lonely_psu": (
            "SELECT A01setor, cast(rep AS INT) AS rep, count(*) AS n_psu, round(sum(factor), 4) AS factor_sum,"
            " round(sum(factor * factor), 4) AS factor_squares FROM (SELECT stratum AS A01setor, rep, factor FROM rep_l WHERE rep > 0)"
            " GROUP BY A01setor, rep"
        ),
        "survey_domain_total": _total("SELECT * FROM h WHERE B03 = 3 AND B12 = 0 AND B06 = 88", ["A01setor"], n),
        "survey_total": _total(_H, ["RA_nome"], {"pessoas": "A01npessoas"}),
        "survey_total_se": _total(_H, ["RA_nome"], {"quartos": "B12"}, ["se"]),
        "survey_total_cv": _total(_H, ["RA_nome"], {"quartos": "B12"}, ["cv"]),
        "survey_total_ci": _total(_H, ["RA_nome"], {"quartos": "B12"}, ["ci"]),
        "survey_total_strict": (
            f"SELECT a.*, CASE WHEN k.B08 IS NULL THEN NULL ELSE b.aluguel_conhecido END AS aluguel_conhecido,"
            f" CASE WHEN k.B08 IS NULL THEN NULL ELSE b.aluguel_conhecido_se END AS aluguel_conhecido_se"
            f" FROM ({strict}) a JOIN ({skipping}) b USING (A01setor, B08) LEFT JOIN ({known}) k USING (A01setor, B08)"
        ),
        "survey_total_ci_design": _total(_H, ["RA_nome"], {"quartos": "B12"}, ["ci"]),  # weights of full rank
        "survey_degrees_of_freedom": f"SELECT DISTINCT RA_nome, {R - 1} AS df FROM h",
        **_linear_queries(),
        "survey_count": _total(_H, ["RA_nome", "B02"], n, ["ci"]),
        "survey_mean": _mean(_H, ["RA_nome"], {"pessoas": "A01npessoas", "adens": "adens"}, ["se", "cv"]),
        "survey_share": _share(_H, ["RA_nome"], "B02", "pct", ["se", "ci"]),
        "survey_multi": _total(
            _H, ["RA_nome"], {"n": "1", "pessoas": "A01npessoas", "quartos": "B12", "rust": "dom_rust"}, ["se", "cv"]
        ),
        "survey_rollup": _total(_H, ["RA_nome", "B02"], n, ["se"], True),
        "survey_repost": _estimates(repost, ["RA_nome"], ["n"], ["se"], 4),
        "income_individual": (
            "SELECT A01nficha, E02, idade_calculada, "
            + ", ".join(f"round({sql}, 4) AS {c}_M" for c, sql in _PERSONAL.items())
            + f", round({_INDIVIDUAL}, 4) AS renda_individual FROM pes"
        ),
        "income_household": "SELECT A01nficha, round(renda_dom, 8) AS renda_dom, pessoas, round(renda_pc, 8) AS renda_pc FROM renda",
        "price_inflator": "SELECT classe, mes, round(inflator, 8) AS inflator FROM infl",
        "real_income": (
            f"SELECT A01nficha, round(renda, 4) AS renda, round(renda * inflator_geral, 4) AS renda_real FROM"
            f" (SELECT A01nficha, {_INDIVIDUAL} AS renda FROM pes) LEFT JOIN (SELECT A01nficha, inflator_geral FROM hm) USING (A01nficha)"
        ),
        "profile_gender_race": f"SELECT {_GENDER} AS genero, {_RACE} AS raca, count(*) AS n FROM pes GROUP BY 1, 2",
        "profile_job": f"SELECT A01nficha, idade_calculada, {_JOB} AS job FROM pes",
        "age_bands": (
            f"SELECT A01nficha, {_AGE} AS faixa_idade, CASE WHEN E02 = 1 THEN 'Chefe' WHEN E02 <> 1 THEN 'não chefe' END AS situacao FROM pes"
        ),
        "income_bands": f"SELECT A01nficha, {_income_band('x')} AS faixa_renda_ind FROM (SELECT A01nficha, {_INDIVIDUAL} AS x FROM pes)",
        "headship_rate": (
            'SELECT faixa_idade, round(chefe, 6) AS "Chefe", round(outro, 6) AS "não chefe",'
            f" round(chefe / (chefe + outro), 6) AS taxadechefia FROM ({_RATE})"
        ),
        "headship_population": _total(
            f"SELECT * EXCLUDE (situacao_chefia), situacao_chefia AS situacao FROM ({_ADULTS})",
            ["faixa_idade", "situacao"], n, ["ci"], design="r",
        ),
        "dhde_population": _total(
            _ELIGIBLE, ["RA_nome", "faixa_renda_ind", "faixa_idade", "raca", "genero", "job"], {"pop": "1"}, ["ci"], design="r"
        ),
        "dhde_cells": _rounded(_CELLS, 4, ["pop", "taxadechefia", "dhde"]),
        "dhde_by_region": f"SELECT RA_nome, round(sum(dhde), 4) AS dhde FROM ({_CELLS}) GROUP BY RA_nome",
        "dhde_by_income_band": demand_by_band,
        "dhde_classes": (
            f"SELECT b.RA_nome, faixa_renda_ind, round(dhde, 4) AS dhde, ra_num, {_demand_class('dhde')} AS cat"
            f" FROM ({_BANDS}) b LEFT JOIN ({_POLYGONS}) g ON g.nome = b.RA_nome"
        ),
        "precarious_class": _total(_H, [*cells, "domicilio"], n, ["ci"]),
        "precarious_by_region": _total("SELECT * FROM h WHERE domicilio IS NOT NULL", ["RA_nome"], n, ["ci"]),
        "precarious_table": _rounded(
            f"SELECT *, {_PRECARIOUS_SUM} FROM ("
            + _wide(
                f"SELECT RA_nome, domicilio, sum(w) AS n FROM h WHERE domicilio IS NOT NULL GROUP BY 1, 2",
                ["RA_nome"], "domicilio", "n", _KINDS,
            )
            + ")",
            4,
            [*_KINDS.values(), "habitação precária"],
        ),
        "precarious_share": precarious_share,
        "precarious_share_table": _rounded(
            f"SELECT *, {_PRECARIOUS_SUM} FROM ("
            + _wide(
                "SELECT RA_nome, domicilio, sum(w) / sum(sum(w)) OVER (PARTITION BY RA_nome) AS pct FROM h GROUP BY RA_nome, domicilio",
                ["RA_nome"], "domicilio", "pct", _KINDS,
            )
            + f") WHERE RA_nome IN (SELECT RA_nome FROM h WHERE domicilio IS NOT NULL)",
            6,
            [*_KINDS.values(), "habitação precária"],
        ),
        "precarious_rollup": _total(_H, ["RA_nome"], flags3, ["cv"], True),
        "cohabitation_flags": _total(_H, ["RA_nome", "job", "genero", "raca"], coab3, ["cv"]),
        "cohabitation_rollup": _total(_H, ["RA_nome"], coab3, ["cv"], True),
        "cohabitation_components_long": " UNION ALL ".join(
            f"SELECT RA_nome, job, genero, raca, '{c}' AS componente, {c} AS n FROM ({long_coab})" for c in ("fam_conv", "comodo")
        ),
        "cohabitation_class": cohabitation,
        "cohabitation_by_region": _total("SELECT * FROM h WHERE situacao <> 'Demais'", ["RA_nome"], n, ["ci"]),
        "cohabitation_share_table": _rounded(
            'SELECT *, "Cômodo" + "Famílias conviventes" AS "coabitaçao" FROM ('
            + _wide(
                "SELECT RA_nome, situacao, sum(w) / sum(sum(w)) OVER (PARTITION BY RA_nome) AS pct FROM h GROUP BY RA_nome, situacao",
                ["RA_nome"], "situacao", "pct", dict(list(_COHABITING.items())[:2]),
            )
            + ") WHERE RA_nome IN (SELECT RA_nome FROM h WHERE situacao <> 'Demais')",
            6,
            [*list(_COHABITING.values())[:2], "coabitaçao"],
        ),
        "cohabitation_share": f"SELECT * FROM ({_share(_H, ['RA_nome'], 'situacao', 'pct', ['cv'])}) WHERE situacao <> 'Demais'",
        "cohabitation_table": _rounded(
            'SELECT *, "Cômodo" + "Famílias conviventes" AS "coabitaçao" FROM ('
            + _wide("SELECT RA_nome, situacao, sum(w) AS n FROM h GROUP BY 1, 2", ["RA_nome"], "situacao", "n", _COHABITING)
            + ")",
            4,
            [*_COHABITING.values(), "coabitaçao"],
        ),
        "rent_burden": _total(_RENT, ["RA_nome"], {"onus_aluguel": "onus_aluguel"}, ["cv"], True),
        "rent_burden_share": rent_share,
        "rent_burden_table": _wide(
            _total(_RENT, ["RA_nome", "onus_aluguel"], n, []), ["RA_nome"], "onus_aluguel", "n", {"0": "sem ônus", "1": "ônus excessivo"}
        ),
        "overcrowding": _total(_H, ["RA_nome"], {"adens": "adens"}, ["cv"], True),
        "overcrowding_share": f"SELECT * FROM ({_share(_H, ['RA_nome'], 'adens', 'pct', ['cv'])}) WHERE adens = 1",
        "overcrowding_table": _wide(
            _total(_H, ["RA_nome", "adens"], n, []),
            ["RA_nome"], "adens", "n", {"0": "sem adensamento", "1": "adensamento excessivo"},
        ),
        "deficit_total": _total(_H, ["RA_nome"], {"deficit_habit": "deficit_habit"}, ["se", "cv", "ci"], True),
        "deficit_rate": _mean(_H, ["RA_nome"], {"deficit_habit": "deficit_habit"}, ["cv"], True),
        "deficit_share": _share(_H, ["RA_nome"], "deficit_habit", "n", ["cv"]),
        "deficit_composition": composition,
        "deficit_composition_legacy": legacy,
        "composition_table": _wide(composition, ["RA_nome"], "composicao", "n", {f"'{x}'": x for x in labels}),
        "composition_table_legacy": _wide(legacy, ["RA_nome"], "composicao", "n", {f"'{x}'": x for x in labels if x != "precariedade e adensamento"}),
        "deficit_dominant": f"SELECT * FROM ({_total(dominant, ['RA_nome', 'dominante'], n, ['ci'])}) WHERE dominante <> 'sem deficit'",
        "lot_status": f"SELECT * FROM ({_total(_H, ['RA_nome', 'deficit_habit', 'lote'], n, ['ci'])}) WHERE deficit_habit = 1",
        "component_totals": " UNION ALL ".join(
            f"SELECT '{name}' AS comp, round(sum(w * {c}), 4) AS n FROM h"
            for name, c in {
                "precariedade": "habit_prec",
                "coabitaçao": "cohabit_familiar",
                "adensamento": "adens",
                "onus": "onus_aluguel",
            }.items()
        ),
        "deficit_final_table": final,
        "deficit_components_long": " UNION ALL ".join(
            f"SELECT RA_nome, '{c}' AS componente, {c} AS n FROM ({final})"
            for c in ("habit_prec", "adens", "cohabit_familiar", "onus_aluguel")
        ),
        "profile_hierarchy": hierarchies,
        "population_by_region": f"SELECT *, {region} AS RA_nome FROM ({_POPULATION})",
        "dwelling_type_by_region": f'SELECT A01ra, flat AS "{_FLAT}", house AS "Casa" FROM ({_TYPES})',
        "occupied_area": f"SELECT ra_cira, round(sum(n), 4) AS areaocupada FROM ({_AREA_CELLS}) GROUP BY ra_cira",
        "occupied_area_cumulative": _rounded(
            "SELECT ra_cira, " + ", ".join(f"max(CASE WHEN ano = '{y}' THEN csum END) AS \"{y}\"" for y in _YEARS)
            + f" FROM ({_AREA_RUNNING}) GROUP BY ra_cira",
            4,
            _YEARS,
        ),
        "density_table": (
            'SELECT cast(a.ra_cira AS VARCHAR) AS ra_cira, round_even(areaocupada, 2) AS areaocupada, RA_nome, round_even(n, 2) AS n, ra_codigo, round_even(area, 2) AS area,'
            ' round_even(n / areaocupada, 2) AS "densidade urbana", round_even(n / area, 2) AS "densidade demográfica",'
            f' flat AS "{_FLAT}", house AS "Casa" FROM (SELECT ra_cira, sum(n) AS areaocupada FROM ({_AREA_CELLS}) GROUP BY 1) a'
            f" LEFT JOIN (SELECT A01ra, {region} AS RA_nome, sum(w) AS n FROM people GROUP BY A01ra) p ON p.A01ra = a.ra_cira"
            f" LEFT JOIN ({_POLYGONS}) g ON g.ra_cira = cast(a.ra_cira AS VARCHAR) LEFT JOIN ({_TYPES}) t ON t.A01ra = a.ra_cira"
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {name: _with(sql) for name, sql in _queries().items()}
