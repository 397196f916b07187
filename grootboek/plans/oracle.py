"""The SQL each named query is checked against, written from the definitions rather than from the operators.

Where an operator takes a shortcut that needs proof (leave-one-out by counts, settlements by day counts, the nearest
charge by running values, neighbours by cells), the SQL here does it the plain way: row by row, pair by pair.
"""

from __future__ import annotations

from grootboek.plans.fixtures import (
    BANK_CELLS,
    BANK_CSV_CELLS,
    BANK_ORDER,
    BANK_SETTLEMENT,
    CARD_BLOCK,
    CARD_EVENT,
    CARD_FILE,
    CARD_HEAD,
    CARD_TAIL,
    DMY_TEXT,
    YMD_TEXT,
)


def _select(mapping: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in mapping.items())


_BANK_NAMES = ", ".join(BANK_ORDER)
_SETTLEMENT = _select({name: BANK_SETTLEMENT[name] for name in BANK_ORDER})

LEDGERS = f"""
WITH RECURSIVE bank0 AS (
  SELECT {_select(BANK_ORDER)}
  FROM (SELECT *, o_orderkey AS k FROM orders) o
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT {_SETTLEMENT} FROM events WHERE event_type = 'signup'
), bank AS (
  SELECT *, md5(concat(raw_date, description, memo, CAST(balance_after AS VARCHAR))) AS tx_id,
    CASE WHEN category = 'Interne overboeking' THEN 'internal'
         WHEN category = 'Overige uitgaven' AND subcategory = 'creditcard' AND direction = 'Af'
          AND account = 'Rekening A' THEN 'cc_settlement'
         WHEN subcategory IN ('sparen', 'van spaarrekening') THEN 'saving'
         WHEN direction = 'Bij' AND category = 'Inkomsten' THEN 'income'
         WHEN direction = 'Bij' THEN 'refund' WHEN direction = 'Af' THEN 'expense'
         ELSE 'unclassified' END AS flow_kind
  FROM (SELECT *, {YMD_TEXT} AS raw_date, CAST(year(tx_date) * 100 + month(tx_date) AS BIGINT) AS ym FROM bank0)
), card AS (
  SELECT *, md5(concat(raw_date, raw_description, card_type, token)) AS tx_id,
    CASE WHEN direction = 'Bij' AND card_type = 'Incasso' THEN 'cc_settlement'
         WHEN direction = 'Af' AND card_type IN ('Betaling', 'Kosten') THEN 'expense'
         WHEN category = 'Interne overboeking' THEN 'internal'
         WHEN direction = 'Bij' THEN 'refund' WHEN direction = 'Af' THEN 'expense'
         ELSE 'unclassified' END AS flow_kind
  FROM (SELECT *, {DMY_TEXT} AS raw_date, CAST(year(tx_date) * 100 + month(tx_date) AS BIGINT) AS ym,
          regexp_replace(CAST(CASE WHEN direction = 'Bij' THEN amount ELSE -amount END AS VARCHAR), '\\.?0+$', '')
            AS token
        FROM (SELECT {_select(CARD_EVENT)} FROM events))
), ledger AS (
  SELECT 'bank' AS src, id, tx_id, tx_date, ym, account, counter_account, direction, amount, category, subcategory,
    description, merchant, orig_category, orig_subcategory, similarity, NULL AS card_type, flow_kind FROM bank
  UNION ALL
  SELECT 'cc', id, tx_id, tx_date, ym, account, NULL, direction, amount, category, subcategory,
    description, merchant, orig_category, orig_subcategory, similarity, card_type, flow_kind FROM card
), review AS (SELECT * FROM ledger WHERE flow_kind NOT IN ('internal', 'cc_settlement'))
"""

ORACLE: dict[str, str] = {}


def _add(name: str, sql: str, *ctes: str) -> None:
    ORACLE[name] = LEDGERS + "".join(", " + cte.strip() for cte in ctes) + "\n" + sql.strip()


def _d(sql: str, name: str) -> str:
    return f"CAST({sql} AS DOUBLE) AS {name}"


def _i(sql: str, name: str) -> str:
    return f"CAST({sql} AS BIGINT) AS {name}"


_NET = "coalesce(sum(CASE flow_kind WHEN 'expense' THEN amount WHEN 'refund' THEN -amount ELSE 0 END), 0)"
_WHOLE = "ym BETWEEN 199501 AND 200112"


def _sum(condition: str) -> str:
    return f"coalesce(sum(CASE WHEN {condition} THEN amount END), 0)"


# Pay cycle, by intervals between start dates.
_STARTS = """
spine AS (
  SELECT CAST(year(m) * 100 + month(m) AS BIGINT) AS named_ym, CAST(year(p) * 100 + month(p) AS BIGINT) AS calendar_ym,
         CAST(p AS DATE) AS p
  FROM (SELECT m, m - INTERVAL 1 MONTH AS p
        FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2002-02-01', INTERVAL 1 MONTH) t(m))
), early AS (
  SELECT ym, min(day(tx_date)) AS d FROM bank
  WHERE category = 'Inkomsten' AND subcategory = 'salaris' AND direction = 'Bij' AND day(tx_date) BETWEEN 20 AND 25
  GROUP BY ym
), starts AS (
  SELECT named_ym, calendar_ym, CAST(coalesce(d, 25) AS BIGINT) AS payday,
         p + CAST(coalesce(d, 25) - 1 AS INT) AS start_date
  FROM spine LEFT JOIN early ON ym = calendar_ym
), cuts AS (
  SELECT *, lead(start_date) OVER (ORDER BY start_date) AS next_start FROM starts
), cycled AS (
  SELECT l.*, named_ym AS bucket FROM ledger l JOIN cuts ON tx_date >= start_date AND tx_date < next_start
  WHERE named_ym BETWEEN 199501 AND 200112
)
"""
_MONTHS = """
months AS (
  SELECT CAST(year(m) * 100 + month(m) AS BIGINT) AS ym
  FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) t(m)
)
"""


def _kpis(table: str, where: str, n: int, cat: str = "TRUE") -> str:
    return f"""
SELECT {_d('expense', 'expense')}, {_d('refund', 'refund')}, {_d('income', 'income')}, {_d('internal', 'internal')},
  {_d('saving_in', 'saving_in')}, {_d('saving_out', 'saving_out')}, {_d('cc', 'cc')},
  {_d('expense - refund', 'expenses_net')}, {_d('income - (expense - refund)', 'delta')},
  {_d('saving_in - saving_out', 'saving')},
  round(CAST(expense - refund AS DOUBLE) / {n}, 2) AS avg_month, round(CAST(income AS DOUBLE) / {n}, 2) AS avg_income,
  CAST({n} AS BIGINT) AS n_months
FROM (SELECT {_sum(f"{cat} AND flow_kind = 'expense'")} AS expense, {_sum(f"{cat} AND flow_kind = 'refund'")} AS refund,
  {_sum(f"{cat} AND flow_kind = 'income'")} AS income,
  {_sum("flow_kind = 'internal' AND direction = 'Af'")} AS internal,
  {_sum("flow_kind = 'saving' AND direction = 'Af'")} AS saving_in,
  {_sum("flow_kind = 'saving' AND direction = 'Bij'")} AS saving_out,
  {_sum("flow_kind = 'cc_settlement' AND src = 'bank'")} AS cc
  FROM {table} WHERE {where})
"""


_add("kpis", _kpis("ledger", _WHOLE, 84))
_add(
    "kpis_one_category",
    _kpis(
        "ledger",
        "tx_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND account = 'Rekening A'",
        12,
        "category = 'Huishouden'",
    ),
)
_add("kpis_paycycle", _kpis("cycled", "TRUE", 84), _STARTS)


def _net_by(label: str, where: str) -> str:
    return f"""
SELECT {label} AS label, {_d(_sum("flow_kind = 'expense'"), 'expense')}, {_d(_sum("flow_kind = 'refund'"), 'refund')},
  {_d(_NET, 'net')} FROM ledger WHERE {_WHOLE} AND {where} GROUP BY {label} HAVING {_NET} <> 0
"""


_add("net_by_category", _net_by("category", "TRUE"))
_add("net_by_subcategory", _net_by("subcategory", "category = 'Huishouden'"))
_add(
    "translated_totals",
    f"SELECT coalesce(CASE WHEN label LIKE '%s%' THEN concat('EN ', label) ELSE label END, '') AS label,"
    f" expense, refund, net FROM ({_net_by('category', 'TRUE')})",
)
_add(
    "income_by_sub",
    f"SELECT subcategory AS label, {_d('sum(amount)', 'amount')}, count(*) AS n FROM ledger"
    f" WHERE {_WHOLE} AND flow_kind = 'income' GROUP BY subcategory HAVING sum(amount) <> 0",
)


def _stack(table: str, bucket: str, label: str, where: str) -> str:
    return f"""
SELECT m.ym AS ym, l.label AS label, {_d('coalesce(s.net, 0)', 'net')}
FROM months m CROSS JOIN (SELECT DISTINCT coalesce({label}, '') AS label FROM {table} WHERE {where}) l
LEFT JOIN (SELECT {bucket} AS ym, coalesce({label}, '') AS label, {_NET} AS net FROM {table} WHERE {where}
  GROUP BY 1, 2) s ON s.ym = m.ym AND s.label = l.label
"""


_add("monthly_stack", _stack("ledger", "ym", "category", _WHOLE), _MONTHS)
_add("monthly_stack_paycycle", _stack("cycled", "bucket", "subcategory", "TRUE"), _STARTS, _MONTHS)
_add(
    "income_vs_expense",
    f"""
SELECT m.ym AS ym, a.account AS account, {_d('coalesce(income, 0)', 'income')}, {_d('coalesce(expenses, 0)', 'expenses')}
FROM months m CROSS JOIN (VALUES ('Rekening A'), ('Rekening B')) a(account)
LEFT JOIN (SELECT ym, account, {_sum("flow_kind = 'income'")} AS income, {_NET} AS expenses FROM ledger
  WHERE {_WHOLE} GROUP BY ym, account) s ON s.ym = m.ym AND s.account = a.account
""",
    _MONTHS,
)


def _known(column: str) -> str:
    return (
        f"CASE WHEN {column} IN ('spaarrekening', 'Oranje Spaarrekening') OR {column} LIKE 'Rekening %'"
        f" THEN {column} END"
    )


def _legs(name: str, merchant: str) -> str:
    other = f"coalesce({_known('counter_account')}, {_known(merchant)})"
    return f"""
{name} AS (
  SELECT *, CASE WHEN direction = 'Af' THEN account ELSE {other} END AS from_account,
    CASE WHEN direction = 'Af' THEN {other} ELSE account END AS to_account FROM ledger
)
"""


_BANK_LEGS = _legs("legs", "(CASE WHEN src = 'bank' THEN merchant END)")
_ALL_LEGS = _legs("legs", "merchant")
_TRANSFERS = f"""
transfers AS (
  SELECT ym, from_account, to_account, sum(amount) AS amount, count(*) AS n FROM legs
  WHERE {_WHOLE} AND flow_kind = 'internal' GROUP BY 1, 2, 3
)
"""
_add("transfer_legs_of_rows", "SELECT src, id, from_account, to_account FROM legs", _ALL_LEGS)
_add(
    "transfers_monthly",
    f"SELECT ym, from_account, to_account, {_d('amount', 'amount')}, n FROM transfers",
    _BANK_LEGS,
    _TRANSFERS,
)
_add(
    "transfer_totals",
    f"SELECT from_account, to_account, {_d('sum(amount)', 'amount')}, {_i('sum(n)', 'n')} FROM transfers GROUP BY 1, 2",
    _BANK_LEGS,
    _TRANSFERS,
)
_SAVING = f"""
saved AS (
  SELECT ym, account, {_sum("subcategory = 'sparen' AND direction = 'Af'")} AS deposit,
    {_sum("subcategory = 'van spaarrekening' AND direction = 'Bij'")} AS withdrawal, count(*) AS n
  FROM ledger WHERE {_WHOLE} AND flow_kind = 'saving' GROUP BY ym, account
)
"""
_add(
    "saving_monthly",
    f"SELECT ym, account, {_d('deposit', 'deposit')}, {_d('withdrawal', 'withdrawal')}, n,"
    f" {_d('deposit - withdrawal', 'net')} FROM saved",
    _SAVING,
)
_add(
    "saving_series",
    f"""
SELECT m.ym AS ym, {_d('coalesce(sum(deposit), 0)', 'deposit')}, {_d('coalesce(sum(withdrawal), 0)', 'withdrawal')},
  {_d('coalesce(sum(deposit - withdrawal), 0)', 'net')} FROM months m LEFT JOIN saved s ON s.ym = m.ym GROUP BY m.ym
""",
    _SAVING,
    _MONTHS,
)
_add(
    "saving_by_account",
    f"SELECT account, {_d('sum(deposit)', 'deposit')}, {_d('sum(withdrawal)', 'withdrawal')},"
    f" {_d('sum(deposit - withdrawal)', 'net')}, {_i('sum(n)', 'n')} FROM saved GROUP BY account",
    _SAVING,
)
_add(
    "refund_monthly",
    f"SELECT ym, category, subcategory, account, {_d('sum(amount)', 'amount')}, count(*) AS n FROM ledger"
    f" WHERE {_WHOLE} AND flow_kind = 'refund' GROUP BY 1, 2, 3, 4",
)
_add("unclassified_count", f"SELECT count(*) AS n FROM ledger WHERE {_WHOLE} AND flow_kind = 'unclassified'")
_add(
    "latest_month",
    """
SELECT 'calendar' AS cycle, max(ym) AS ym FROM bank
UNION ALL
SELECT 'payday', named_ym FROM cuts, (SELECT max(tx_date) AS d FROM bank) WHERE d >= start_date AND d < next_start
""",
    _STARTS,
)
_add(
    "year_bounds",
    f"SELECT {_i('min(year(tx_date))', 'first_year')}, {_i('max(year(tx_date))', 'last_year')} FROM ledger",
)
_add(
    "payday_starts",
    "SELECT named_ym, calendar_ym, payday, strftime(start_date, '%Y-%m-%d') AS start_date FROM starts",
    _STARTS,
)
_PAIRS = """
pairs AS (SELECT DISTINCT category, subcategory FROM ledger WHERE category <> '' AND subcategory <> ''),
allowed AS (SELECT * FROM pairs UNION VALUES ('Vervoer', 'bekeuringen'), ('Vervoer', 'taxi'),
  ('Educatie', 'schoolbijdrage'), ('Aflossing', 'creditcard'), ('Inkomsten', 'ERE'), ('Huishouden', 'glazenwassers'))
"""
_add("category_pairs", "SELECT * FROM pairs", _PAIRS)
_add("allowed_pairs", "SELECT * FROM allowed", _PAIRS)
_add("accounts", "SELECT DISTINCT account FROM ledger WHERE account IN ('Rekening A', 'Rekening B')")
_add(
    "unique_category_for_sub",
    "SELECT subcategory, CASE WHEN count(DISTINCT category) = 1 THEN min(category) END AS category FROM ledger"
    " WHERE category <> '' GROUP BY subcategory",
)
_add(
    "vocabulary",
    """
SELECT DISTINCT namespace, source FROM (
  SELECT 'hoofd' AS namespace, category AS source FROM ledger UNION ALL SELECT 'sub', subcategory FROM ledger
  UNION ALL SELECT 'af_bij', direction FROM ledger UNION ALL SELECT 'rekening', account FROM ledger
  UNION ALL SELECT 'mutatiesoort', mutation_kind FROM bank UNION ALL SELECT 'cc_type', card_type FROM card)
WHERE source <> ''
""",
)

_IBAN = "'\\b[A-Z]{2}\\d{2}[A-Z0-9]{10,30}\\b'"


def _spaced(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


def _strip_iban(c: str) -> str:
    no_iban = f"regexp_replace(coalesce({c}, ''), {_IBAN}, '…', 'g')"
    return _spaced(f"regexp_replace({no_iban}, '\\d{{8,}}', '…', 'g')")


def _normal(c: str) -> str:
    lowered = f"replace(lower({_strip_iban(c)}), 'ß', 'ss')"
    return f"left({_spaced(f'regexp_replace({lowered}, $q$[.,;:/-]$q$, $q$$q$, $q$g$q$)')}, 200)"


def _redact(c: str, limit: int = 80) -> str:
    text = _spaced(f"regexp_replace(coalesce({c}, ''), {_IBAN}, '…', 'g')")
    return f"CASE WHEN length({text}) > {limit} THEN concat(left({text}, {limit - 1}), '…') ELSE {text} END"


def _tx_list(table: str, where: str) -> str:
    return f"""
SELECT * EXCLUDE (total), CAST(total > 200 AS BIGINT) AS truncated FROM (
  SELECT row_number() OVER (ORDER BY tx_date DESC, id DESC, src) AS place, src, id,
    strftime(tx_date, '%d-%m-%Y') AS date, account, direction, {_d('amount', 'amount')}, category, subcategory,
    {_redact('description')} AS description, count(*) OVER () AS total
  FROM {table} WHERE {_WHOLE} AND {where})
WHERE place <= 200
"""


_add("tx_list_spend", _tx_list("ledger", "flow_kind IN ('expense', 'refund')"))
_add("tx_list_income", _tx_list("ledger", "flow_kind = 'income' AND subcategory = 'salaris'"))
_add(
    "tx_list_transfer_leg",
    _tx_list("legs", "flow_kind = 'internal' AND from_account = 'Rekening A' AND to_account = 'Rekening B'"),
    _ALL_LEGS,
)

# Memory: each row against the label counts of all others with its text.
_CORPUS = f"""
corpus AS (
  SELECT src, tx_id, id, {_normal('description')} AS text_key, trim(coalesce(direction, '')) AS way,
    coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory FROM review
), counts AS (
  SELECT text_key, way, category, subcategory, count(*) AS c FROM corpus WHERE text_key <> '' AND way <> ''
  GROUP BY 1, 2, 3, 4
), recalled AS (
  SELECT text_key, way, category, subcategory, c AS hits, sum(c) OVER g AS n, count(*) OVER g AS labels,
    row_number() OVER (PARTITION BY text_key, way ORDER BY c DESC, category, subcategory) AS place
  FROM counts WINDOW g AS (PARTITION BY text_key, way)
), remembered AS (
  SELECT text_key, way, category, subcategory, CAST(n AS BIGINT) AS n, hits / n AS share, labels = 1 AS unanimous
  FROM recalled WHERE place = 1 AND n >= 3 AND hits / n >= 0.8 AND category <> '' AND subcategory <> ''
), others AS (
  SELECT o.text_key, o.way, o.category AS own_category, o.subcategory AS own_sub, l.category, l.subcategory,
    l.c - CASE WHEN l.category = o.category AND l.subcategory = o.subcategory THEN 1 ELSE 0 END AS c
  FROM counts o JOIN counts l ON o.text_key = l.text_key AND o.way = l.way
), judged AS (
  SELECT *, sum(c) OVER g AS n, count(*) OVER g AS labels,
    row_number() OVER (PARTITION BY text_key, way, own_category, own_sub ORDER BY c DESC, category) AS place
  FROM others WHERE c > 0 WINDOW g AS (PARTITION BY text_key, way, own_category, own_sub)
), loo AS (
  SELECT k.src, k.tx_id, k.category, k.subcategory, j.category AS m_category, j.subcategory AS m_sub,
    CAST(j.n AS BIGINT) AS m_n, j.c / j.n AS m_share, j.labels = 1 AS m_unanimous
  FROM corpus k LEFT JOIN judged j ON j.text_key = k.text_key AND j.way = k.way AND j.own_category = k.category
    AND j.own_sub = k.subcategory AND place = 1 AND n >= 3 AND c / n >= 0.8 AND j.category <> '' AND j.subcategory <> ''
), suggested AS (
  SELECT src, tx_id, coalesce(m_category, CASE WHEN category <> '' THEN category ELSE '?' END) AS category,
    coalesce(m_sub, CASE WHEN subcategory <> '' THEN subcategory ELSE '?' END) AS subcategory,
    CAST(CAST(coalesce(m_share, 0) AS DECIMAL(6,4)) AS DOUBLE) AS score, CAST(coalesce(m_unanimous, FALSE) AS BIGINT) AS unanimous,
    coalesce(m_n, 0) AS neighbor_n, CASE WHEN m_n IS NULL THEN 'none' ELSE 'text' END AS layer,
    CAST(m_n IS NOT NULL AND (m_category <> category OR m_sub <> subcategory) AS BIGINT) AS disagrees FROM loo
)
"""
_add(
    "text_memory",
    "SELECT text_key, way AS direction, category, subcategory, n, share, CAST(unanimous AS BIGINT) AS unanimous"
    " FROM remembered",
    _CORPUS,
)
_add("loo_suggestions", "SELECT * FROM suggested", _CORPUS)
_MERCHANTS = """
spelled AS (
  SELECT merchant, lower(trim(merchant)) AS merchant_key, category, subcategory, count(*) AS n FROM bank
  WHERE direction = 'Af' AND category NOT IN ('Interne overboeking', 'Inkomsten')
    AND subcategory NOT IN ('sparen', 'creditcard', 'van spaarrekening') AND trim(merchant) <> ''
  GROUP BY 1, 2, 3, 4
), ranked_merchants AS (
  SELECT *, sum(n) OVER g AS total, count(*) OVER g AS spellings,
    row_number() OVER (PARTITION BY merchant_key ORDER BY n DESC) AS place
  FROM spelled WINDOW g AS (PARTITION BY merchant_key)
), majority AS (
  SELECT merchant_key, category, subcategory, n FROM ranked_merchants WHERE place = 1 AND n >= 8 AND n / total >= 0.75
), mixed AS (
  SELECT merchant_key FROM ranked_merchants
  WHERE place = 1 AND NOT (n >= 8 AND n / total >= 0.75) AND spellings > 1 AND total >= 8
)
"""
_SPLITS = """
splits AS (
  SELECT lower(trim(description)) AS text_key, count(DISTINCT category || chr(31) || subcategory) AS labels FROM review
  WHERE trim(description) <> '' GROUP BY 1 HAVING count(DISTINCT category || chr(31) || subcategory) > 1
)
"""
_add("merchant_majority", "SELECT * FROM majority", _MERCHANTS)
_add("mixed_merchants", "SELECT * FROM mixed", _MERCHANTS)
_add("split_texts", "SELECT * FROM splits", _SPLITS)
_add(
    "index_stats",
    "SELECT src, flow_kind, count(*) AS n, CAST(flow_kind NOT IN ('internal', 'cc_settlement') AS BIGINT) AS indexed"
    " FROM ledger GROUP BY 1, 2",
)


def _tally(source: str, h: str = "p_category", s: str = "p_sub", by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {lead}n, shown, category_ok, pair_ok, n - shown AS silent,
  CASE WHEN shown > 0 THEN category_ok / shown END AS category_acc, CASE WHEN shown > 0 THEN pair_ok / shown END AS pair_acc
FROM (SELECT {lead}count(*) AS n, count({h}) AS shown, count(*) FILTER ({h} = category) AS category_ok,
  count(*) FILTER ({h} = category AND {s} = subcategory) AS pair_ok FROM {source} {group})
"""


_add("matcher_tally", _tally("loo", "m_category", "m_sub"), _CORPUS)
_add(
    "confusion_pairs",
    "SELECT category AS gold, m_category AS suggested, count(*) AS n FROM loo WHERE m_category <> category"
    " GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, gold, suggested LIMIT 8",
    _CORPUS,
)
_VARIANTS = """
stored AS (
  SELECT *, coalesce(m_category, category) AS s_category, coalesce(m_sub, subcategory) AS s_sub FROM loo
), usable AS (
  SELECT *, s_category <> '' AND s_sub <> '' AS complete FROM stored
), variants AS (
  SELECT 'A' AS variant, category, subcategory, CASE WHEN complete THEN s_category END AS p_category,
    CASE WHEN complete THEN s_sub END AS p_sub FROM usable
  UNION ALL SELECT 'B', category, subcategory, CASE WHEN complete AND m_unanimous THEN s_category END,
    CASE WHEN complete AND m_unanimous THEN s_sub END FROM usable
  UNION ALL SELECT 'M', category, subcategory, m_category, m_sub FROM usable
  UNION ALL SELECT 'D', category, subcategory,
    CASE WHEN m_n IS NOT NULL THEN m_category WHEN complete AND m_unanimous THEN s_category END,
    CASE WHEN m_n IS NOT NULL THEN m_sub WHEN complete AND m_unanimous THEN s_sub END FROM usable
)
"""
_add("matcher_variants", _tally("variants", by="variant"), _CORPUS, _VARIANTS)
_CONFUSION = """
SELECT * FROM (
  SELECT variant, category AS gold, p_category AS suggested, count(*) AS n,
    row_number() OVER (PARTITION BY variant ORDER BY count(*) DESC, category, p_category) AS place
  FROM variants WHERE p_category <> category GROUP BY variant, category, p_category HAVING count(*) >= 2) WHERE place <= 8
"""
_add("confusion_by_variant", _CONFUSION, _CORPUS, _VARIANTS)

# Import.
_add("bank_ids", "SELECT id, tx_id FROM bank")
_add("card_ids", "SELECT id, token, tx_id FROM card")


def _anonymous(c: str) -> str:
    one = c
    for iban, label in (("NL00BANK0123456789", "Rekening A"), ("NL00BANK0987654321", "Rekening B")):
        pattern = "\\s*".join(iban)
        one = f"regexp_replace({one}, '{pattern}', '{label}', 'gi')"
    return f"regexp_replace({one}, 'Voorbeeldnaam', '<geanonimiseerd>', 'gi')"


_BANK_PREVIEW = f"""
cells AS (SELECT {_select(BANK_CELLS)} FROM bank),
parsed AS (
  SELECT *, md5(concat(raw_date, raw_description, raw_memo, raw_balance)) AS tx_id,
    TRY_CAST(TRY_STRPTIME(raw_date, '%Y%m%d') AS DATE) AS tx_date,
    abs(TRY_CAST(CASE WHEN raw_amount LIKE '%,%' THEN replace(replace(replace(raw_amount, ' ', ''), '.', ''), ',', '.')
      ELSE replace(raw_amount, ' ', '') END AS DECIMAL(18,2))) AS amount,
    TRY_CAST(raw_balance AS DECIMAL(18,2)) AS balance_after
  FROM cells
), cleaned AS (
  SELECT *, CASE WHEN tx_date IS NULL THEN 'date' WHEN amount IS NULL THEN 'amount'
      WHEN balance_after IS NULL THEN 'balance' END AS error,
    {_anonymous('raw_description')} AS a_description, {_anonymous('raw_memo')} AS a_memo,
    {_anonymous('raw_account')} AS a_account, {_anonymous('raw_counter_account')} AS a_counter FROM parsed
), looked AS (
  SELECT c.*, r.category AS m_category, r.subcategory AS m_sub, r.n AS m_n, r.share AS m_share, r.unanimous,
    CASE WHEN error IS NOT NULL THEN 'fout' WHEN b.tx_id IS NOT NULL THEN 'dubbel' ELSE 'nieuw' END AS status
  FROM cleaned c LEFT JOIN (SELECT DISTINCT tx_id FROM bank) b ON b.tx_id = c.tx_id
  LEFT JOIN remembered r ON error IS NULL AND r.text_key = {_normal('a_description')} AND r.way = c.direction
), preview AS (
  SELECT file, pos AS id, tx_id, status, error,
    CASE WHEN status <> 'nieuw' THEN '' WHEN unanimous AND m_share >= 0.999 AND m_n >= 3 THEN 'sure' ELSE 'doubt' END AS tone,
    CASE WHEN error IS NOT NULL THEN '' WHEN m_n IS NOT NULL THEN 'text' ELSE 'fallback' END AS source,
    tx_date, CASE WHEN error IS NULL THEN {_redact('a_description')} ELSE '' END AS shown, direction, amount,
    CASE WHEN error IS NULL THEN coalesce(m_category, CASE WHEN direction = 'Bij' THEN 'Inkomsten' ELSE 'Overige uitgaven' END)
      END AS category,
    CASE WHEN error IS NULL THEN coalesce(m_sub, 'overig') END AS subcategory,
    CASE WHEN error IS NULL AND a_account LIKE 'Rekening _%' THEN a_account ELSE '' END AS account,
    coalesce(m_n, 0) AS mem_n, m_share AS mem_share,
    CASE WHEN error IS NULL THEN a_description ELSE '' END AS description,
    CASE WHEN error IS NULL AND a_counter LIKE 'Rekening _%' THEN a_counter ELSE '' END AS counter_account,
    code, mutation_kind, CASE WHEN error IS NULL THEN a_memo ELSE '' END AS memo, balance_after
  FROM looked
)
"""
_add(
    "bank_import_preview",
    f"SELECT * EXCLUDE (tx_date, amount, balance_after), strftime(tx_date, '%Y-%m-%d') AS tx_date,"
    f" {_d('amount', 'amount')}, {_d('balance_after', 'balance_after')} FROM preview",
    _CORPUS,
    _BANK_PREVIEW,
)
_add(
    "known_ids",
    "SELECT file, id AS pos, tx_id, CAST(status = 'dubbel' AS BIGINT) AS known FROM preview WHERE error IS NULL",
    _CORPUS,
    _BANK_PREVIEW,
)
_add(
    "bank_import_counts",
    "SELECT count(*) FILTER (status = 'nieuw') AS n_new, count(*) FILTER (status = 'dubbel') AS n_dupe,"
    " count(*) FILTER (status = 'fout') AS n_err, count(*) FILTER (status = 'nieuw' AND tone = 'sure') AS n_sure,"
    " count(*) FILTER (status = 'nieuw' AND tone = 'doubt') AS n_doubt FROM preview",
    _CORPUS,
    _BANK_PREVIEW,
)
_add(
    "audit_raw_overlap",
    "SELECT count(*) AS id_join FROM preview p JOIN bank b ON trim(b.tx_id) = trim(p.tx_id || ' ')",
    _CORPUS,
    _BANK_PREVIEW,
)
_add(
    "import_commit",
    f"""
SELECT id, tx_id, strftime(tx_date, '%Y-%m-%d') AS tx_date,
  CAST(year(tx_date) * 100 + month(tx_date) AS BIGINT) AS ym, description, account, counter_account, code, direction,
  {_d('amount', 'amount')}, mutation_kind, memo, {_d('balance_after', 'balance_after')},
  CASE WHEN kind = '1-URGENT' THEN 'Huishouden' ELSE category END AS category,
  CASE WHEN kind = '1-URGENT' THEN 'boodschappen' ELSE subcategory END AS subcategory,
  CASE WHEN kind = '2-HIGH' THEN 'Winkel …' ELSE '' END AS merchant
FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY file, id) AS place,
  min(mutation_kind) OVER (PARTITION BY tx_id) AS kind FROM preview WHERE status = 'nieuw') WHERE place = 1
""",
    _CORPUS,
    _BANK_PREVIEW,
)
_AMOUNT = "[+-] ?\\d{1,3}(?:\\.\\d{3})*,\\d{2}"
_KNOWN_LINE = f"'^\\d{{2}}-\\d{{2}}-\\d{{4}} .+ (Incasso|Betaling|Kosten) {_AMOUNT}$'"
_OTHER_LINE = f"'^\\d{{2}}-\\d{{2}}-\\d{{4}} .+ ([A-Za-z][A-Za-z]{{2,}}) {_AMOUNT}$'"
_CARD_PREVIEW = f"""
parts AS (SELECT id, {CARD_FILE} AS file, {CARD_BLOCK} AS block, {CARD_HEAD} AS head, {CARD_TAIL} AS tail FROM card),
lines AS (
  SELECT file, block, id * 2 AS seq, CASE WHEN id % 53 = 0 OR id % 7 = 0 THEN head ELSE concat(head, ' ', tail) END AS line
  FROM parts
  UNION ALL SELECT file, block, id * 2 + 1, tail FROM parts WHERE id % 7 = 0 AND id % 53 <> 0
), followed AS (
  SELECT *, lead(line) OVER (PARTITION BY file ORDER BY block, seq) AS following FROM lines
), stitched AS (
  SELECT file, seq, CASE WHEN NOT regexp_matches(line, {_KNOWN_LINE}) AND NOT regexp_matches(line, {_OTHER_LINE})
      AND coalesce(regexp_matches(following, '^[A-Za-z][A-Za-z]{{2,}} {_AMOUNT}$'), FALSE)
      AND (regexp_matches(concat(line, ' ', following), {_KNOWN_LINE})
        OR regexp_matches(concat(line, ' ', following), {_OTHER_LINE}))
    THEN concat(line, ' ', following) ELSE line END AS line
  FROM followed WHERE regexp_matches(line, '^\\d{{2}}-\\d{{2}}-\\d{{4}}')
), typed AS (
  SELECT *, regexp_matches(line, {_KNOWN_LINE}) AS known,
    regexp_matches(line, {_KNOWN_LINE}) OR regexp_matches(line, {_OTHER_LINE}) AS matched,
    TRY_CAST(TRY_STRPTIME(left(line, 10), '%d-%m-%Y') AS DATE) AS tx_date FROM stitched
), split_up AS (
  SELECT *, CASE WHEN NOT matched OR tx_date IS NULL THEN 'unmatched' END AS error,
    CASE WHEN known THEN regexp_extract(line, '(Incasso|Betaling|Kosten)', 1)
      ELSE regexp_extract(line, {_OTHER_LINE}, 1) END AS t_type,
    trim(regexp_replace(CASE WHEN known THEN regexp_replace(line, ' (Incasso|Betaling) {_AMOUNT}$', '')
      ELSE regexp_replace(line, ' [A-Za-z][A-Za-z]{{2,}} {_AMOUNT}$', '') END, '^\\d{{2}}-\\d{{2}}-\\d{{4}} ', '')) AS t_desc,
    TRY_CAST(replace(replace(replace(regexp_extract(line, '({_AMOUNT})$', 1), ' ', ''), '.', ''), ',', '.')
      AS DECIMAL(18,2)) AS signed FROM typed
), hashed AS (
  SELECT *, CASE WHEN error IS NULL THEN regexp_replace(CAST(signed AS VARCHAR), '\\.?0+$', '') END AS token,
    CASE WHEN error IS NULL THEN CASE WHEN t_type = 'Incasso' OR signed > 0 THEN 'Bij' ELSE 'Af' END END AS direction
  FROM split_up
), keyed AS (
  SELECT *, CASE WHEN error IS NULL THEN md5(concat(left(line, 10), t_desc, t_type, token)) ELSE '' END AS tx_id,
    CASE WHEN error IS NULL THEN {_anonymous('t_desc')} ELSE '' END AS description FROM hashed
), matched_up AS (
  SELECT k.*, r.category AS m_category, r.subcategory AS m_sub, r.n AS m_n, r.share AS m_share, r.unanimous,
    CASE WHEN error IS NOT NULL THEN 'fout' WHEN c.tx_id IS NOT NULL THEN 'dubbel' ELSE 'nieuw' END AS status,
    coalesce(t_type = 'Incasso', FALSE) AND error IS NULL AS by_rule
  FROM keyed k LEFT JOIN (SELECT DISTINCT tx_id FROM card) c ON c.tx_id = k.tx_id
  LEFT JOIN remembered r ON error IS NULL AND r.text_key = {_normal('description')} AND r.way = 'Af'
)
"""
_add(
    "card_import_preview",
    f"""
SELECT seq, file, tx_id, status, error,
  CASE WHEN status <> 'nieuw' THEN '' WHEN by_rule THEN 'sure'
    WHEN unanimous AND m_share >= 0.999 AND m_n >= 3 THEN 'sure' ELSE 'doubt' END AS tone,
  CASE WHEN error IS NOT NULL THEN '' WHEN by_rule THEN 'regel' WHEN m_n IS NOT NULL THEN 'text' ELSE 'fallback' END AS source,
  strftime(tx_date, '%Y-%m-%d') AS tx_date,
  CASE WHEN error IS NULL THEN {_redact('description')}
    ELSE {_redact("regexp_replace(line, '[0-9]{12,}', '…', 'g')")} END AS shown,
  direction, CASE WHEN matched THEN {_d('abs(signed)', 'x').removesuffix(' AS x')} END AS amount,
  CASE WHEN error IS NOT NULL THEN NULL WHEN by_rule THEN 'Aflossing' ELSE coalesce(m_category, 'Overige uitgaven') END AS category,
  CASE WHEN error IS NOT NULL THEN NULL WHEN by_rule THEN 'creditcard' ELSE coalesce(m_sub, 'overig') END AS subcategory,
  CASE WHEN error IS NULL THEN 'Rekening A' ELSE '' END AS account,
  CASE WHEN by_rule THEN 0 ELSE coalesce(m_n, 0) END AS mem_n, CASE WHEN NOT by_rule THEN m_share END AS mem_share,
  description, CASE WHEN matched THEN t_type END AS card_type, token
FROM matched_up
""",
    _CORPUS,
    _CARD_PREVIEW,
)

# Each credit against every debit with its text.
_add(
    "refund_follows_charge",
    f"""
SELECT c.src, c.id, CAST(gap AS BIGINT) AS gap, CAST(same_amount AS BIGINT) AS same_amount,
  d_category AS charge_category, d_sub AS charge_subcategory, CAST(coalesce(labels > 1, FALSE) AND d_id IS NOT NULL AS BIGINT) AS in_doubt
FROM (SELECT * FROM flows WHERE direction = 'Bij') c LEFT JOIN best b ON b.src = c.src AND b.id = c.id
LEFT JOIN equal_labels e ON e.src = c.src AND e.text_key = c.text_key AND e.amount = c.amount
""",
    f"""
flows AS (
  SELECT src, id, direction, amount, category, subcategory, {_normal('description')} AS text_key,
    year(tx_date) * 10000 + month(tx_date) * 100 + day(tx_date) AS ymd FROM ledger WHERE flow_kind IN ('expense', 'refund')
), met AS (
  SELECT c.src, c.id, d.id AS d_id, d.category AS d_category, d.subcategory AS d_sub, d.amount = c.amount AS same_amount,
    abs(d.ymd - c.ymd) AS gap
  FROM flows c JOIN flows d ON d.src = c.src AND d.text_key = c.text_key
  WHERE c.direction = 'Bij' AND d.direction = 'Af'
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, id ORDER BY same_amount DESC, gap, d_id) AS place FROM met)
  WHERE place = 1
), equal_labels AS (
  SELECT src, text_key, amount, count(DISTINCT (coalesce(category, '?'), coalesce(subcategory, '?'))) AS labels
  FROM flows WHERE direction = 'Af' GROUP BY 1, 2, 3
)
""",
)
ORACLE["redacted_documents"] = f"""
SELECT doc_id, {_redact('text')} AS shown, md5({_strip_iban('text')}) AS clean_md5,
  left({_strip_iban('text')}, 200) AS index_text, md5({_anonymous('text')}) AS anonymous_md5,
  CAST(regexp_matches(regexp_replace(text, '[\\s.]', '', 'g'), '^([A-Za-z]{{2}}\\d{{2}}[A-Za-z0-9]{{10,30}}|\\d{{6,14}}|[A-Za-z]\\d{{6,12}})$')
    AS BIGINT) AS secret, CAST(length({_normal('text')}) AS BIGINT) AS key_length
FROM documents
"""


# Settlements: card rows of an amount one after the other, each looking through the bank rows not used yet.
def _settled(cards: str, banks: str, visible: tuple[str, str]) -> tuple[str, str]:
    low, high = visible
    steps = f"""
cards AS (
  SELECT *, row_number() OVER (PARTITION BY amount ORDER BY tx_date, id) AS turn FROM card
  WHERE direction = 'Bij' AND card_type = 'Incasso' AND {cards}
), banks AS (
  SELECT * FROM bank WHERE category = 'Overige uitgaven' AND subcategory = 'creditcard' AND direction = 'Af'
    AND account = 'Rekening A' AND {banks}
), offered AS (
  SELECT amount, list({{'d': tx_date, 'id': id}}) AS rows FROM banks GROUP BY amount
), walk AS (
  SELECT amount, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS card_id,
    CAST(NULL AS BIGINT) AS bank_id FROM (SELECT DISTINCT amount FROM cards)
  UNION ALL
  SELECT amount, turn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.id) END, card_id, pick.id
  FROM (SELECT w.amount, c.turn, w.used, c.id AS card_id,
      list_min(list_transform(list_filter(coalesce(o.rows, []), lambda b: NOT list_contains(w.used, b.id)
          AND b.d - c.tx_date BETWEEN 2 AND 4), lambda b: {{'lag': b.d - c.tx_date, 'id': b.id}})) AS pick
    FROM walk w JOIN cards c ON c.amount = w.amount AND c.turn = w.turn + 1 LEFT JOIN offered o ON o.amount = w.amount)
), settled AS (
  SELECT 'x' AS x, c.amount, c.tx_date AS card_date, b.tx_date AS bank_date, c.id AS card_id, b.id AS bank_id,
    coalesce(b.account, c.account) AS account, coalesce(b.direction, c.direction) AS direction,
    c.category, c.subcategory, c.card_type
  FROM walk w JOIN cards c ON c.id = w.card_id LEFT JOIN banks b ON b.id = w.bank_id WHERE w.turn > 0
  UNION ALL
  SELECT 'x', amount, NULL, tx_date, NULL, id, account, direction, category, subcategory, NULL FROM banks
  WHERE id NOT IN (SELECT bank_id FROM walk WHERE bank_id IS NOT NULL)
)
"""
    final = f"""
SELECT CASE WHEN card_id IS NULL THEN 'unmatched_topup' WHEN bank_id IS NULL THEN 'unmatched_cc' ELSE 'matched' END AS status,
  {_d('amount', 'amount')}, strftime(card_date, '%Y-%m-%d') AS card_date, strftime(bank_date, '%Y-%m-%d') AS bank_date,
  strftime(coalesce(card_date, bank_date), '%Y-%m-%d') AS sort_date, card_id, bank_id, account, direction, category,
  subcategory, card_type FROM settled
WHERE coalesce(card_date BETWEEN DATE '{low}' AND DATE '{high}', FALSE)
   OR coalesce(bank_date BETWEEN DATE '{low}' AND DATE '{high}', FALSE)
"""
    return final, steps


_add(
    "settlements",
    *_settled(
        "tx_date BETWEEN DATE '1994-12-28' AND DATE '2001-12-31'",
        "tx_date BETWEEN DATE '1995-01-01' AND DATE '2002-01-04'",
        ("1995-01-01", "2001-12-31"),
    ),
)
_add(
    "settlements_one_year",
    *_settled(
        "account = 'Rekening A' AND tx_date BETWEEN DATE '1996-12-28' AND DATE '1997-12-31'",
        "tx_date BETWEEN DATE '1997-01-01' AND DATE '1998-01-04'",
        ("1997-01-01", "1997-12-31"),
    ),
)


# Review.
_QUEUES: dict[str, str] = {}


def _queue(name: str, where: str, *ctes: str) -> None:
    _QUEUES[{"doubt": "twijfel", "search": "zoek"}.get(name[6:], name[6:])] = where
    _add(
        name,
        f"SELECT src, tx_id, ym, category, subcategory, flow_kind FROM review s WHERE {_WHOLE} AND {where}",
        *ctes,
    )


_LAYER = "EXISTS (SELECT 1 FROM suggested g WHERE g.src = s.src AND g.tx_id = s.tx_id AND g.layer = 'text'"
_queue("queue_doubt", f"(lower(subcategory) = 'overig' OR flow_kind = 'unclassified') AND {_LAYER})", _CORPUS)
_queue("queue_mismatch", f"{_LAYER} AND g.disagrees = 1)", _CORPUS)
_queue("queue_overig", "lower(subcategory) = 'overig'")
_queue(
    "queue_saving_odd",
    "flow_kind = 'saving' AND (merchant IS NULL OR merchant NOT IN ('spaarrekening', 'Oranje Spaarrekening'))",
)
_queue("queue_unclassified", "flow_kind = 'unclassified'")
_queue("queue_corrected", "orig_category IS NOT NULL")
_queue(
    "queue_search",
    "(description ILIKE '%furn%' OR merchant ILIKE '%furn%' OR category ILIKE '%furn%' OR subcategory ILIKE '%furn%')",
)
_queue("queue_all", "TRUE")
_queue(
    "queue_split_text",
    f"trim(description) IN (SELECT trim(description) FROM review WHERE {_WHOLE} GROUP BY 1"
    " HAVING count(DISTINCT (coalesce(category, chr(1)), coalesce(subcategory, chr(1)))) > 1)",
)
_add(
    "split_text_page",
    f"""
SELECT src, tx_id, ym, place - 20 AS place FROM (
  SELECT src, tx_id, ym, row_number() OVER (ORDER BY ym DESC, src DESC, tx_id DESC) AS place
  FROM review WHERE {_WHOLE} AND {_QUEUES['split_text']}) WHERE place BETWEEN 21 AND 40
""",
)
_add(
    "review_page_deep",
    f"""
SELECT src, tx_id, ym, place, 'all' AS queue FROM (
  SELECT src, tx_id, ym, row_number() OVER (ORDER BY ym DESC, src, tx_id DESC) AS place FROM review WHERE {_WHOLE})
WHERE place BETWEEN 1201 AND 1220
UNION ALL
SELECT src, tx_id, ym, place, 'split_text' FROM (
  SELECT src, tx_id, ym, row_number() OVER (ORDER BY ym DESC, src DESC, tx_id DESC) AS place, count(*) OVER () AS n
  FROM review WHERE {_WHOLE} AND {_QUEUES['split_text']}) WHERE place > (n + 19) // 20 * 20 - 20
""",
)
_add(
    "queue_search_indexed",
    f"""
SELECT src, tx_id, needle FROM review,
  unnest(['  FURN%', 'Huis', 'ery ger', 'BUILDING CHINA NL00', 'sho', 'op', 'nowhere at all']) u(needle)
WHERE {_WHOLE} AND (
  contains(lower(coalesce(description, '')), lower(trim(replace(needle, '%', '')))) OR
  contains(lower(coalesce(merchant, '')), lower(trim(replace(needle, '%', '')))) OR
  contains(lower(coalesce(category, '')), lower(trim(replace(needle, '%', '')))) OR
  contains(lower(coalesce(subcategory, '')), lower(trim(replace(needle, '%', '')))))
""",
)
_add(
    "rows_by_id",
    f"SELECT src, tx_id, {_d('amount', 'amount')}, category, flow_kind FROM"
    " (SELECT * FROM ledger ORDER BY tx_id, src LIMIT 5) WHERE flow_kind NOT IN ('internal', 'cc_settlement')",
)
_add(
    "queue_totals",
    " UNION ALL ".join(
        f"SELECT '{name}' AS queue, count(*) AS n FROM review s WHERE {_WHOLE} AND {where}" for name, where in _QUEUES.items()
    ),
    _CORPUS,
)
_add(
    "review_page",
    f"""
SELECT src, tx_id, ym, CAST(day(tx_date) AS BIGINT) AS day, account, direction, {_d('amount', 'amount')}, category,
  subcategory, {_redact('description')} AS description, lower(trim(description)) AS text_key,
  {_redact('merchant', 40)} AS merchant, trim(coalesce(merchant, '')) AS merchant_name, orig_category, orig_subcategory,
  {_d('similarity', 'similarity')}, flow_kind, CAST(coalesce(orig_category, '') <> '' AS BIGINT) AS corrected
FROM review WHERE {_WHOLE} AND lower(subcategory) = 'overig' ORDER BY ym DESC, src, tx_id DESC LIMIT 20 OFFSET 40
""",
)
_FLAGS = """
base AS (
  SELECT r.src, r.tx_id, r.id, r.flow_kind, r.direction, r.amount, coalesce(r.category, '') AS category,
    coalesce(r.subcategory, '') AS subcategory, r.subcategory AS raw_sub, coalesce(r.orig_category, '') <> '' AS corrected,
    lower(trim(coalesce(r.merchant, ''))) AS merchant_key, l.m_category, l.m_sub, l.m_n, l.m_share,
    j.category AS j_category, j.subcategory AS j_sub, x.merchant_key IS NOT NULL AS is_mixed, t.text_key IS NOT NULL AS is_split
  FROM review r JOIN loo l ON l.src = r.src AND l.tx_id = r.tx_id
  LEFT JOIN majority j ON j.merchant_key = lower(trim(r.merchant)) LEFT JOIN mixed x ON x.merchant_key = lower(trim(r.merchant))
  LEFT JOIN splits t ON t.text_key = lower(trim(r.description))
), shops AS (
  SELECT *, flow_kind = 'saving' AND merchant_key <> '' AND merchant_key NOT IN ('spaarrekening', 'oranje spaarrekening') AS saving_shop
  FROM base
), steps AS (
  SELECT *, CASE WHEN saving_shop AND direction = 'Bij' AND amount >= 50 THEN 'shop_saving_large'
      WHEN saving_shop THEN 'shop_saving_small'
      WHEN category = 'Inkomsten' AND lower(subcategory) = 'overig' AND j_category IS NOT NULL THEN 'shop_as_income'
      WHEN lower(subcategory) = 'overig' THEN 'overig' END AS step FROM shops
), ruled AS (
  SELECT *, coalesce(step IN ('shop_saving_small', 'shop_as_income'), FALSE) AND j_category IS NOT NULL AS by_rule FROM steps
), flagged AS (
  SELECT src, tx_id, id, corrected, by_rule, is_split OR is_mixed AS unsafe, step, m_n, m_share,
    concat_ws(',', CASE WHEN m_n IS NOT NULL AND (m_category <> category OR m_sub IS DISTINCT FROM raw_sub) THEN 'knn_mismatch' END,
      CASE WHEN is_split THEN 'split_text' END, CASE WHEN is_mixed THEN 'mixed_entity' END, step,
      CASE WHEN flow_kind = 'unclassified' THEN 'unclassified' END) AS flags,
    CASE WHEN step = 'shop_saving_large' THEN NULL WHEN by_rule THEN j_category ELSE m_category END AS suggest_category,
    CASE WHEN step = 'shop_saving_large' THEN NULL WHEN by_rule THEN j_sub ELSE m_sub END AS suggest_subcategory,
    CASE WHEN step = 'shop_saving_large' THEN NULL WHEN by_rule THEN 'regel' WHEN m_n IS NOT NULL THEN 'text' END AS suggest_source
  FROM ruled
)
"""
_add(
    "doubt_flags",
    """
SELECT src, tx_id, flags, suggest_category, suggest_subcategory, suggest_source,
  CAST(suggest_source IS NOT NULL AND (by_rule OR NOT unsafe) AS BIGINT) AS above,
  CAST((by_rule OR (coalesce(step = 'overig', FALSE) AND m_n IS NOT NULL AND NOT unsafe)) AND NOT corrected AS BIGINT) AS bulk_ok,
  CAST(flags <> '' AS BIGINT) AS doubt FROM flagged
""",
    _CORPUS,
    _MERCHANTS,
    _SPLITS,
    _FLAGS,
)
_ITEMS = """
items AS (
  SELECT id * 2 + CASE src WHEN 'bank' THEN 0 ELSE 1 END AS seq, src, tx_id, flow_kind,
    CASE id % 6 WHEN 0 THEN 'Vervoer' WHEN 1 THEN 'Huishouden' WHEN 2 THEN 'Huishouden' WHEN 3 THEN 'Onbekend'
      WHEN 4 THEN 'Interne overboeking' ELSE '' END AS category,
    CASE WHEN id % 6 = 0 THEN 'taxi' WHEN id % 6 = 1 AND id > 100 THEN 'tuin' WHEN id % 6 = 2 THEN 'tuin'
      WHEN id % 6 = 3 THEN 'paar' WHEN id % 6 = 4 THEN 'intern' ELSE '' END AS subcategory,
    id % 6 = 1 AND id > 100 AS is_new, id % 6 = 0 AS taxi FROM ledger
)
"""


def _judged(items: str) -> str:
    return f"""
introduced AS (
  SELECT category, subcategory, min(seq) AS since FROM {items} WHERE is_new AND category <> '' AND subcategory <> ''
    AND category <> 'Interne overboeking' AND NOT (category = 'Overige uitgaven' AND subcategory = 'creditcard')
    AND flow_kind NOT IN ('internal', 'cc_settlement') GROUP BY 1, 2
), verdicts AS (
  SELECT i.*, CASE WHEN i.category = '' OR i.subcategory = '' THEN 'empty'
      WHEN a.category IS NULL AND NOT is_new AND NOT coalesce(since < seq, FALSE) THEN 'pair'
      WHEN i.category = 'Interne overboeking' OR (i.category = 'Overige uitgaven' AND i.subcategory = 'creditcard') THEN 'structural'
      WHEN flow_kind IN ('internal', 'cc_settlement') THEN 'missing' END AS reason
  FROM {items} i LEFT JOIN allowed a ON a.category = i.category AND a.subcategory = i.subcategory
  LEFT JOIN introduced n ON n.category = i.category AND n.subcategory = i.subcategory
)
"""


_add(
    "corrected_ledger",
    f"""
SELECT l.src, l.tx_id, coalesce(v.category, l.category) AS category, coalesce(v.subcategory, l.subcategory) AS subcategory,
  CASE WHEN v.taxi THEN 'Taxi …' ELSE l.merchant END AS merchant,
  CASE WHEN v.seq IS NULL THEN l.orig_category ELSE coalesce(l.orig_category, l.category) END AS orig_category,
  CASE WHEN v.seq IS NULL THEN l.orig_subcategory ELSE coalesce(l.orig_subcategory, l.subcategory) END AS orig_subcategory,
  CASE WHEN v.seq IS NULL THEN {_d('l.similarity', 'x').removesuffix(' AS x')} WHEN v.taxi THEN 0.91::DOUBLE END AS similarity
FROM ledger l LEFT JOIN (SELECT * FROM verdicts WHERE reason IS NULL) v ON v.src = l.src AND v.tx_id = l.tx_id
""",
    _PAIRS,
    _ITEMS,
    _judged("items"),
)
_add(
    "correction_rejects",
    "SELECT seq, src, tx_id, reason FROM verdicts WHERE reason IS NOT NULL",
    _PAIRS,
    _ITEMS,
    _judged("items"),
)
_add(
    "bulk_corrections",
    "SELECT seq, src, tx_id, reason FROM verdicts",
    _CORPUS,
    _MERCHANTS,
    _SPLITS,
    _FLAGS,
    _PAIRS,
    _ITEMS,
    """
bulk AS (
  SELECT i.seq, i.src, i.tx_id, i.flow_kind, i.is_new,
    CASE WHEN i.category <> '' AND i.subcategory <> '' THEN i.category ELSE coalesce(f.suggest_category, '') END AS category,
    CASE WHEN i.category <> '' AND i.subcategory <> '' THEN i.subcategory ELSE coalesce(f.suggest_subcategory, '') END AS subcategory
  FROM items i LEFT JOIN flagged f ON f.src = i.src AND f.tx_id = i.tx_id
)
""",
    _judged("bulk"),
)
_add(
    "undo_ledger",
    f"""
SELECT src, tx_id, CASE WHEN hit THEN orig_category ELSE category END AS category,
  CASE WHEN hit THEN orig_subcategory ELSE subcategory END AS subcategory, merchant,
  CASE WHEN NOT hit THEN orig_category END AS orig_category, CASE WHEN NOT hit THEN orig_subcategory END AS orig_subcategory,
  CASE WHEN NOT hit THEN CAST(similarity AS DOUBLE) END AS similarity
FROM (SELECT *, account = 'Rekening A' AND coalesce(orig_category, '') <> '' AND flow_kind NOT IN ('internal', 'cc_settlement')
  AS hit FROM ledger)
""",
)
_add(
    "relabel_counts",
    """
SELECT src, category, subcategory, count(*) AS n, 'before' AS moment FROM ledger
WHERE subcategory = 'furniture' AND category IN ('Huishouden', 'Wonen') GROUP BY 1, 2, 3
UNION ALL
SELECT src, 'Wonen', subcategory, count(*), 'after' FROM ledger
WHERE subcategory = 'furniture' AND category IN ('Huishouden', 'Wonen') GROUP BY 1, 2, 3
""",
)


# Neighbours: every query against every vector of its direction.
def _near(name: str, scope: str = "", rows: str = "embeddings", label: str = "label") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS point_id, q.{label} AS q_label, p.{label} AS label,
      list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY
        list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) DESC, CAST(p.vec_id AS VARCHAR))
        AS place
    FROM {rows} q JOIN {rows} p ON p.vec_id <> q.vec_id {scope}) WHERE place <= 5
), {name}_votes AS (
  SELECT point_id, count(DISTINCT label) AS labels, count(*) AS n, arg_min(label, place) AS top, any_value(q_label) AS q_label
  FROM {name} GROUP BY point_id
)
"""


_SAME = "AND p.label % 2 = q.label % 2"

ORACLE["knn_top5"] = (
    f"WITH {_near('near', _SAME)} SELECT point_id, place, concat('C', label % 5) AS category,"
    " round(score, 4) AS score FROM near"
)
ORACLE["knn_proposals"] = f"""
WITH {_near('near', _SAME)}, tallies AS (
  SELECT point_id, string_agg(concat('C', label % 5, ':s', label, ':', n), ','
    ORDER BY n DESC, concat('C', label % 5), concat('s', label)) AS split
  FROM (SELECT point_id, label, count(*) AS n FROM near GROUP BY 1, 2) GROUP BY point_id
)
SELECT point_id, concat('C', top % 5) AS category, concat('s', top) AS subcategory,
  CAST(labels = 1 AND n >= 3 AS BIGINT) AS unanimous, n AS neighbor_n, CAST(labels > 1 AS BIGINT) AS mixed, split
FROM near_votes JOIN tallies USING (point_id)
"""
ORACLE["knn_variants"] = f"""
WITH {_near('near', _SAME)}, {_near('wide')}, variants AS (
  SELECT 'C' AS variant, q_label, top FROM near_votes
  UNION ALL SELECT 'C''', q_label, CASE WHEN labels = 1 AND n >= 3 THEN top END FROM near_votes
  UNION ALL SELECT 'all', q_label, top FROM wide_votes
  UNION ALL SELECT 'all''', q_label, CASE WHEN labels = 1 AND n >= 3 THEN top END FROM wide_votes
)
SELECT variant, n, shown, category_ok, pair_ok, n - shown AS silent,
  CASE WHEN shown > 0 THEN category_ok / shown END AS category_acc, CASE WHEN shown > 0 THEN pair_ok / shown END AS pair_acc
FROM (SELECT variant, count(*) AS n, count(top) AS shown, count(*) FILTER (top % 5 = q_label % 5) AS category_ok,
  count(*) FILTER (top = q_label) AS pair_ok FROM variants GROUP BY variant)
"""
ORACLE["knn_recall"] = """
SELECT count(*) AS queries, CAST(sum(least(5, others)) AS BIGINT) AS neighbours, CAST(1 AS BIGINT) AS enough
FROM (SELECT count(*) OVER (PARTITION BY label % 2) - 1 AS others FROM embeddings)
"""
# Ledger rows that have a vector: their own neighbours before or after memory.
_PROPOSED = f"""
vectors AS (
  SELECT e.vec_id, e.embedding, b.direction AS way, {{'c': l.category, 's': l.subcategory}} AS pair, l.*
  FROM loo l JOIN bank b ON l.src = 'bank' AND b.tx_id = l.tx_id JOIN embeddings e ON e.vec_id = b.id
), {_near('near', 'AND p.way = q.way', 'vectors', 'pair')}, variants AS (
  SELECT v.*, n.labels = 1 AND n.n >= 3 AS unanimous, n.top.c AS k_category, n.top.s AS k_sub
  FROM vectors v LEFT JOIN near_votes n ON n.point_id = CAST(v.vec_id AS VARCHAR)
), judged_variants AS (
  SELECT 'C' AS variant, category, subcategory, k_category AS p_category, k_sub AS p_sub FROM variants
  UNION ALL SELECT 'C''', category, subcategory, CASE WHEN unanimous THEN k_category END, CASE WHEN unanimous THEN k_sub END
  FROM variants
  UNION ALL SELECT 'E', category, subcategory,
    CASE WHEN m_n IS NOT NULL THEN m_category WHEN unanimous THEN k_category END,
    CASE WHEN m_n IS NOT NULL THEN m_sub WHEN unanimous THEN k_sub END FROM variants
)
"""
_add("knn_memory_variants", _tally("judged_variants", by="variant"), _CORPUS, _PROPOSED)
_add("knn_confusion", _CONFUSION.replace("FROM variants", "FROM judged_variants"), _CORPUS, _PROPOSED)
_add(
    "point_ids",
    f"""
SELECT concat(left(h, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
  substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1), substr(h, 18, 3), '-',
  substr(h, 21, 12)) AS point_id, left({_strip_iban('description')}, 200) AS index_text, src, tx_id,
  coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory, {_strip_iban('merchant')} AS merchant,
  coalesce(direction, '') AS direction, coalesce(account, '') AS account, CAST(year(tx_date) AS BIGINT) AS year,
  CAST(month(tx_date) AS BIGINT) AS month, flow_kind, CAST(0 AS BIGINT) AS corrected
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('ledger:', src, ':', tx_id))) AS h FROM review)
""",
)

ORACLE["points_stored"] = """
WITH p AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS point_id, label, len(embedding) AS size FROM embeddings
), b AS (SELECT *, left(md5(point_id), 2) AS bucket FROM p
), known AS (SELECT DISTINCT bucket FROM b WHERE vec_id % 4 <> 0 OR vec_id % 10 = 0
), written AS (
  SELECT bucket, CASE
    WHEN bucket IN (SELECT bucket FROM b WHERE vec_id % 100 = 3) THEN 4
    WHEN bucket IN (SELECT bucket FROM b WHERE vec_id % 50 = 7) THEN 3
    WHEN bucket IN (SELECT bucket FROM b WHERE vec_id % 10 = 0) THEN 2 ELSE 1 END AS generation FROM known
)
SELECT point_id, CASE WHEN label % 2 = 0 THEN 'Af' ELSE 'Bij' END AS direction,
  CASE WHEN vec_id % 10 = 0 THEN 'N' ELSE concat('C', label % 5) END AS category,
  CASE WHEN vec_id % 50 = 7 THEN 'P' ELSE concat('s', label) END AS subcategory, bucket,
  CAST(generation AS BIGINT) AS generation, CAST(size AS BIGINT) AS size
FROM b JOIN written USING (bucket) WHERE (vec_id % 4 <> 0 OR vec_id % 10 = 0) AND vec_id % 100 <> 3
"""
_add("suggestions_stored", "SELECT * FROM suggested", _CORPUS)
_add("suggestions_refreshed", "SELECT * FROM suggested", _CORPUS)
_add(
    "suggestions_corrected",
    "SELECT * FROM suggested",
    _CORPUS.replace(
        "coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory FROM review",
        "CASE WHEN src = 'bank' AND id % 9 = 0 THEN 'Wonen' ELSE coalesce(category, '') END AS category,"
        " CASE WHEN src = 'bank' AND id % 9 = 0 THEN 'tuin' ELSE coalesce(subcategory, '') END AS subcategory FROM review",
    ),
)
_add(
    "ledger_copy",
    f"SELECT ym, count(*) AS n, {_d('sum(amount)', 'amount')}, CAST(0 AS BIGINT) AS similarities,"
    " 'copied,skipped' AS outcomes FROM bank GROUP BY ym",
)
_add(
    "stored_terms",
    "SELECT DISTINCT 'hoofd' AS namespace, category AS source, concat('EN ', category) AS text FROM ledger"
    " WHERE category LIKE '%s%'",
)
_add(
    "denied_merchants",
    """
SELECT merchant, CAST(key = '' OR key IN ('persoon', 'spaarrekening')
  OR regexp_full_match(replace(key, '.', ''), 'ing(\\s+bank(\\s+nv)?)?') AS BIGINT) AS denied
FROM (SELECT DISTINCT merchant, lower(trim(coalesce(merchant, ''))) AS key FROM (
  SELECT merchant FROM ledger UNION ALL SELECT ' ' || upper(merchant) FROM ledger UNION ALL SELECT 'I.N.G. Bank'))
""",
)
_add(
    "bank_csv_round_trip",
    f"""
SELECT md5(concat(raw_date, raw_description, raw_memo, raw_balance)) AS tx_id, strftime(tx_date, '%Y-%m-%d') AS tx_date,
  {_d('amount', 'amount')}, direction, raw_description, raw_memo, {_d('balance_after', 'balance_after')},
  CASE WHEN tx_date IS NULL THEN 'date' WHEN amount IS NULL THEN 'amount' WHEN balance_after IS NULL THEN 'balance' END AS error
FROM (SELECT *, TRY_CAST(TRY_STRPTIME(raw_date, '%Y%m%d') AS DATE) AS tx_date,
  abs(TRY_CAST(CASE WHEN raw_amount LIKE '%,%' THEN replace(replace(replace(raw_amount, ' ', ''), '.', ''), ',', '.')
    ELSE replace(raw_amount, ' ', '') END AS DECIMAL(18,2))) AS amount,
  TRY_CAST(raw_balance AS DECIMAL(18,2)) AS balance_after
  FROM (SELECT {_select(BANK_CSV_CELLS)} FROM bank))
""",
)
_add(
    "card_text_round_trip",
    f"""
SELECT tx_id, CASE WHEN error IS NULL THEN strftime(tx_date, '%Y-%m-%d') END AS tx_date,
  CASE WHEN error IS NULL THEN t_desc END AS raw_description,
  CASE WHEN error IS NULL THEN t_type END AS card_type, {_d('CASE WHEN error IS NULL THEN signed END', 'signed')}, direction, error
FROM keyed
""",
    _CORPUS,
    _CARD_PREVIEW,
)
_add(
    "import_neighbours",
    """
SELECT file, id AS pos, status, CASE WHEN mixed AND source <> 'regel' THEN 'doubt' ELSE tone END AS tone,
  CAST(mixed AS BIGINT) AS neighbours_mixed, coalesce(near, '') AS near
FROM (SELECT p.*, n.near, coalesce(n.labels > 1, FALSE) AS mixed FROM preview p LEFT JOIN (
  SELECT r_id, string_agg(concat(vec_id, ':C', label % 5, ':s', label), ',' ORDER BY place) AS near,
    count(DISTINCT label) AS labels
  FROM (
    SELECT r.id AS r_id, p.vec_id, p.label, row_number() OVER (PARTITION BY r.id ORDER BY
      list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) DESC, CAST(p.vec_id AS VARCHAR)) AS place
    FROM preview r JOIN embeddings q ON q.vec_id = r.id
    JOIN embeddings p ON CASE WHEN p.label % 2 = 0 THEN 'Af' ELSE 'Bij' END = r.direction
    WHERE r.status = 'nieuw' AND r.shown <> '') WHERE place <= 5 GROUP BY r_id) n ON n.r_id = p.id)
""",
    _CORPUS,
    _BANK_PREVIEW,
)
_MOVABLE = """
movable AS (
  SELECT src, category, subcategory, CASE WHEN src = 'bank' THEN 'bank' ELSE 'card' END AS table_name FROM ledger
  UNION ALL SELECT src, category, subcategory, 'suggestions' FROM suggested
)
"""
_MOVED = "subcategory = 'furniture' AND category IN ('Huishouden', 'Wonen')"
_add(
    "copy_resumed",
    f"""
SELECT slice, n, n AS ids, CAST(0 AS BIGINT) AS similarities, amount,
  CASE WHEN row_number() OVER (ORDER BY slice) <= 5 THEN 'kept' ELSE 'copied' END AS outcome
FROM (SELECT left(tx_id, 1) AS slice, count(*) AS n, {_d('sum(amount)', 'amount')} FROM bank GROUP BY 1)
""",
)
_add(
    "move_over_tables",
    f"""
SELECT t.src, t.category, t.subcategory, count(*) AS n, t.table_name, 'before' AS moment FROM movable t WHERE {_MOVED} GROUP BY ALL
UNION ALL SELECT src, 'Wonen', subcategory, count(*), table_name, 'after' FROM movable WHERE {_MOVED} GROUP BY ALL
UNION ALL SELECT NULL, 'Huishouden', 'furniture', 0, unnest(['bank', 'card', 'suggestions']), 'left'
""",
    _CORPUS,
    _MOVABLE,
)

_add(
    "move_stored",
    f"""
SELECT src, category, subcategory, count(*) AS n, table_name, 'before' AS moment FROM movable WHERE {_MOVED} GROUP BY ALL
UNION ALL SELECT src, 'Wonen', subcategory, count(*), table_name, 'after' FROM movable WHERE {_MOVED} GROUP BY ALL
""",
    _CORPUS,
    _MOVABLE,
)

# Audits.
_CREDIT = "direction = 'Bij'"
_N_SUM = f"count(*) AS n, {_d('sum(amount)', 'amount')}"
_LOW_HIGH = f"{_d('min(amount)', 'smallest')}, {_d('max(amount)', 'largest')}"
_REFUNDED = f"{_CREDIT} AND category <> 'Inkomsten' AND category <> 'Interne overboeking'" + (
    " AND subcategory NOT IN ('sparen', 'van spaarrekening')"
)
_add(
    "audit_credit_buckets",
    f"""
SELECT CASE WHEN category = 'Interne overboeking' THEN 'internal'
  WHEN subcategory IN ('sparen', 'van spaarrekening') THEN 'saving' WHEN category = 'Inkomsten' THEN 'income'
  ELSE 'refund_or_other' END AS bucket, {_N_SUM} FROM bank WHERE {_CREDIT} GROUP BY 1
""",
)
_add(
    "audit_income_subs",
    f"""
SELECT subcategory, {_N_SUM}, CAST(subcategory IN ('salaris', 'belastingteruggaaf', 'kinderbijslag', 'toeslagen',
  'bijdrage opa', 'bijdrage kado', 'uit bouwdepot', 'van spaarrekening', 'crypto verkoop', 'laadvergoeding') AS BIGINT)
  AS real_income FROM bank WHERE {_CREDIT} AND category = 'Inkomsten' GROUP BY subcategory
""",
)
_add(
    "audit_other_income_merchants",
    f"SELECT merchant, {_N_SUM}, {_LOW_HIGH} FROM bank WHERE {_CREDIT} AND category = 'Inkomsten'"
    " AND subcategory = 'overig' GROUP BY merchant",
)
_add(
    "audit_income_expense_overlap",
    f"""
SELECT i.merchant, income_sub, n_in, amount_in, n_out, amount_out, category_out, subcategory_out
FROM (SELECT merchant, subcategory AS income_sub, count(*) AS n_in, {_d('sum(amount)', 'amount_in')} FROM bank
  WHERE {_CREDIT} AND category = 'Inkomsten' GROUP BY 1, 2) i
JOIN (SELECT merchant, count(*) AS n_out, {_d('sum(amount)', 'amount_out')}, min(category) AS category_out,
  min(subcategory) AS subcategory_out FROM bank WHERE direction = 'Af'
  AND category NOT IN ('Inkomsten', 'Interne overboeking') AND subcategory NOT IN ('sparen', 'creditcard')
  GROUP BY merchant) e ON e.merchant = i.merchant WHERE i.merchant <> ''
""",
)
_add(
    "audit_saving_merchants",
    f"SELECT merchant, {_N_SUM}, {_LOW_HIGH} FROM bank WHERE {_CREDIT} AND subcategory = 'van spaarrekening'"
    " GROUP BY merchant",
)
_add(
    "audit_refund_groups",
    f"SELECT category, subcategory, merchant, {_N_SUM} FROM bank WHERE {_REFUNDED} GROUP BY 1, 2, 3"
    " ORDER BY n DESC, sum(amount) DESC, category, subcategory, merchant LIMIT 40",
)
_add("audit_refund_total", f"SELECT {_N_SUM} FROM bank WHERE {_REFUNDED}")
_add(
    "audit_charging",
    f"SELECT category, subcategory, direction, merchant, {_N_SUM} FROM bank"
    " WHERE subcategory IN ('laadvergoeding', 'laadpaal') GROUP BY 1, 2, 3, 4",
)
_add(
    "audit_card_credits",
    f"SELECT card_type, direction, category, subcategory, {_N_SUM} FROM card WHERE {_CREDIT} GROUP BY 1, 2, 3, 4",
)
_add(
    "audit_id_lengths",
    f"SELECT src, {_i('min(length(tx_id))', 'id_min')}, {_i('max(length(tx_id))', 'id_max')}, count(*) AS n,"
    " count(DISTINCT tx_id) AS distinct_ids FROM ledger GROUP BY src",
)
_add(
    "audit_hash_recipe",
    """
SELECT 'bank' AS src, count(*) AS total,
  count(*) FILTER (md5(concat(raw_date, description, memo, CAST(balance_after AS VARCHAR))) = tx_id) AS matched,
  count(*) FILTER (md5(concat(raw_date, description, CAST(balance_after AS VARCHAR))) = tx_id) AS control_matched FROM bank
UNION ALL
SELECT 'cc', count(*), count(*) FILTER (md5(concat(raw_date, raw_description, card_type, token)) = tx_id),
  count(*) FILTER (md5(concat(raw_date, raw_description, card_type, CAST(amount AS VARCHAR))) = tx_id) FROM card
""",
)


def _words(table: str, src: str, columns: list[str]) -> str:
    one = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM {table}" for c in columns)
    secret = "'^([A-Za-z]{2}\\d{2}[A-Za-z0-9]{10,30}|\\d{6,14}|[A-Za-z]\\d{6,12})$'"
    return f"""
SELECT '{src}' AS src, "column", CASE WHEN value IS NULL THEN '<NULL>'
  WHEN regexp_matches(regexp_replace(value, '[\\s.]', '', 'g'), {secret}) THEN concat('<redacted len=', length(value), '>')
  ELSE value END AS value, n FROM (SELECT "column", value, count(*) AS n FROM ({one}) GROUP BY 1, 2)
"""


_SHARED = ["category", "subcategory", "direction", "merchant", "account"]
_add(
    "profile_frequencies",
    _words("bank", "bank", [*_SHARED, "mutation_kind", "code", "counter_account"])
    + " UNION ALL "
    + _words("card", "cc", _SHARED),
)
_SECRET_ACCOUNT = "regexp_matches(counter_account, '^[A-Z]{2}\\d{2}[A-Z0-9]{10,30}$')"
_add(
    "profile_counter_accounts",
    f"""
SELECT count(DISTINCT counter_account) AS distinct_values,
  count(DISTINCT CASE WHEN counter_account <> '' AND NOT {_SECRET_ACCOUNT} THEN counter_account END) AS label_values,
  count(*) FILTER ({_SECRET_ACCOUNT}) AS secret_like_rows, count(*) FILTER (counter_account = '') AS empty_rows FROM bank
""",
)
_add(
    "profile_counter_account_labels",
    f"SELECT counter_account, count(*) AS n FROM bank WHERE counter_account <> '' AND NOT {_SECRET_ACCOUNT} GROUP BY 1",
)
_add("profile_pairs", "SELECT src, category, subcategory, direction, count(*) AS n FROM ledger GROUP BY 1, 2, 3, 4")
_add(
    "profile_hypotheses",
    """
SELECT src, count(*) FILTER (category = 'Interne overboeking') AS internal_category,
  count(*) FILTER (subcategory = 'creditcard') AS settlement_sub, count(*) FILTER (subcategory = 'sparen') AS deposit_sub,
  count(*) FILTER (subcategory = 'van spaarrekening') AS withdrawal_sub,
  count(*) FILTER (category = 'Aflossing') AS repayment_category,
  count(*) FILTER (category = 'Aflossing' AND direction = 'Bij') AS repayment_credit FROM ledger GROUP BY src
""",
)
_add(
    "profile_date_range",
    "SELECT src, strftime(min(tx_date), '%Y-%m-%d') AS first_date, strftime(max(tx_date), '%Y-%m-%d') AS last_date"
    " FROM ledger GROUP BY src",
)
_add("profile_months", "SELECT src, ym, count(*) AS n FROM ledger GROUP BY 1, 2")
_add(
    "snapshot_check",
    f"""
SELECT src, count(*) AS n, count(DISTINCT tx_id) AS distinct_ids, {_i('min(length(tx_id))', 'id_min')},
  {_i('max(length(tx_id))', 'id_max')}, count(*) FILTER (similarity IS NULL) AS similarity_nulls FROM ledger GROUP BY src
""",
)
