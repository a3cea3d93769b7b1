"""The deterministic core-banking dataset: 22 tables computed from row numbers.

Every table is one select over a range (or over other tables), so Spark can make it at any
size in parallel: a row depends on its number only. What a sequential generator would
remember is looked up instead: the previous transaction by its number, accounts by their
rank among the active accounts of a currency.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Profile:
    customers: int
    accounts: int
    transactions: int
    merchants: int
    audits: int


# Sizes, codes, rates and labels of the dataset.
PROFILES = {"small": Profile(1_000, 1_500, 6_000, 120, 200), "full": Profile(10_000, 20_000, 125_000, 500, 2_000)}
CURRENCIES = [("GBP", "Pound sterling", 2, 1), ("EUR", "Euro", 2, 1), ("USD", "US dollar", 2, 1), ("CHF", "Swiss franc", 2, 1), ("JPY", "Japanese yen", 0, 1)]
PRODUCTS = [
    (1, "CUR-GBP", "Everyday Current", "CURRENT", "GBP", 0, 0, 0, 1), (2, "SAV-GBP", "Flexible Saver", "SAVINGS", "GBP", 225, 0, 0, 1),
    (3, "CUR-EUR", "Euro Current", "CURRENT", "EUR", 0, 0, 250, 1), (4, "CUR-USD", "Dollar Current", "CURRENT", "USD", 0, 0, 250, 1),
    (5, "CRD-GBP", "Credit Account", "CREDIT", "GBP", 1899, 0, 500, 1), (6, "ESC-GBP", "Client Escrow", "ESCROW", "GBP", 0, 10000, 0, 1)]
RATES = [("GBP", "EUR", 1165000), ("GBP", "USD", 1275000), ("EUR", "USD", 1095000), ("USD", "JPY", 149500000), ("GBP", "CHF", 1115000)]
MONTHS = 24
KEYS = {
    "branches": "branch_id", "currencies": "currency_code", "customers": "customer_id", "customer_addresses": "address_id", "kyc_cases": "kyc_case_id",
    "account_products": "product_id", "accounts": "account_id", "account_holders": "account_id, customer_id", "beneficiaries": "beneficiary_id",
    "journal_batches": "batch_id", "merchants": "merchant_id", "ledger_transactions": "transaction_id", "ledger_entries": "entry_id",
    "payment_instructions": "payment_id", "cards": "card_id", "card_authorizations": "authorization_id",
    "fx_rates": "base_currency_code, quote_currency_code, rate_date", "loans": "loan_id", "loan_installments": "loan_id, installment_number",
    "aml_alerts": "alert_id", "aml_alert_transactions": "alert_id, transaction_id", "audit_events": "audit_event_id"}


def _id(prefix: str, number: str, width: int = 8) -> str:
    return f"concat('{prefix}-', lpad(cast({number} as string), {width}, '0'))"


def _pad(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


def _pick(values: str, index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values.split())
    return f"array({listed})[cast({index} as int)]"


def _at(days: str = "0", minutes: str = "0", seconds: str = "0") -> str:
    """ISO time of so much after the dataset's first morning."""
    moment = f"timestamp_ntz'2024-01-01 08:00:00' + make_dt_interval(cast({days} as int), 0, cast({minutes} as int), cast({seconds} as int))"
    return f"""date_format({moment}, "yyyy-MM-dd'T'HH:mm:ss'Z'")"""


def _currency(number: str) -> str:
    return _pick("GBP GBP GBP EUR USD CHF JPY", f"{number} % 7")


def _range(n: int, first: int = 1) -> str:
    return f"(select id as i from range({first}, {n + 1}))"


def _values(rows: list[tuple], names: str) -> str:
    return "select * from values " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}L" for v in r) + ")" for r in rows) + f" as t({names})"


def statements(p: Profile) -> dict[str, str]:
    """The select of each table, in an order in which each uses earlier ones only. Names
    that start with an underscore are helpers, not tables."""
    c, a = p.customers, p.accounts
    business = "i % 5 = 0"
    month = "make_date(2024 + i div 12, cast(i % 12 + 1 as int), 1)"
    s: dict[str, str] = {}
    s["currencies"] = _values(CURRENCIES, "currency_code, name, minor_unit, is_active")
    s["branches"] = f"""select i as branch_id, concat('BR', {_pad('i', 3)}) as branch_code, concat('Synthetic Branch ', {_pad('i', 2)}) as name, 'GB' as country_code,
        concat('201', i % 9, '-01-15') as opened_on, 1L as is_active from {_range(12)}"""
    s["account_products"] = _values(PRODUCTS, "product_id, product_code, name, product_type, default_currency_code, interest_rate_bps, minimum_balance_minor, monthly_fee_minor, is_active")
    s["customers"] = f"""select customer_id, customer_type, given_name, family_name, legal_name,
        case when customer_type = 'BUSINESS' then legal_name else trim(concat(coalesce(given_name, ''), ' ', coalesce(family_name, ''))) end as display_name,
        email, phone, risk_rating, tax_residency_country, status, created_at from (
        select {_id('CUS', 'i')} as customer_id, if({business}, 'BUSINESS', 'INDIVIDUAL') as customer_type, if({business}, null, concat('Synthetic', {_pad('i', 5)})) as given_name,
          if({business}, null, 'Customer') as family_name, if({business}, concat('Synthetic Business ', {_pad('i', 5)}), null) as legal_name,
          concat('customer', {_pad('i', 5)}, '@example.invalid') as email, if(i % 11 = 0, null, concat('+440000', {_pad('i', 6)})) as phone,
          case when i % 37 = 0 then 'HIGH' when i % 7 = 0 then 'MEDIUM' else 'LOW' end as risk_rating, {_pick('GB IE FR DE', 'i % 4')} as tax_residency_country,
          case when i % 113 = 0 then 'REVIEW' when i % 257 = 0 then 'CLOSED' else 'ACTIVE' end as status, {_at('i % 500')} as created_at from {_range(c)})"""
    s["customer_addresses"] = f"""select i as address_id, {_id('CUS', 'i')} as customer_id, if({business}, 'BUSINESS', 'HOME') as address_type, concat(i, ' Test Avenue') as line_1,
        if(i % 3 = 0, 'Fixture Quarter', null) as line_2, concat('Synthetic City ', {_pad('i % 20', 2)}) as city, concat('ZZ', {_pad('i % 100', 2)}, ' ', i % 10, 'ZZ') as postal_code,
        'GB' as country_code, '2024-01-01' as valid_from, cast(null as string) as valid_to, 1L as is_primary from {_range(c)}"""
    s["kyc_cases"] = f"""select {_id('KYC', 'i')} as kyc_case_id, {_id('CUS', 'i')} as customer_id, if(i % 97 = 0, 'PENDING', 'APPROVED') as case_status, i * 17 % 101 as risk_score,
        concat('TEST-KYC-', {_pad('i', 8)}) as verification_reference, {_at('i % 500')} as opened_at, if(i % 97 = 0, null, {_at('i % 500 + 2')}) as reviewed_at,
        if(i % 97 = 0, null, concat('reviewer-', {_pad('i % 12', 2)})) as reviewer, if(i % 13 = 0, 'Synthetic enhanced review', null) as notes from {_range(c)}"""
    s["_account"] = f"""select *, case currency_code when 'GBP' then array(1L, 2L, 5L, 6L)[cast(i % 4 as int)] when 'EUR' then 3L when 'USD' then 4L else 1L end as product_id,
          row_number() over (partition by currency_code, status order by i) - 1 as place from (
        select i, (i - 1) % {c} + 1 as customer, {_currency('i')} as currency_code,
          case when i % 97 = 0 then 'DORMANT' when i % 211 = 0 then 'FROZEN' when i % 389 = 0 then 'CLOSED' else 'ACTIVE' end as status from {_range(a)})"""
    s["accounts"] = f"""select {_id('ACC', 'i')} as account_id, account_reference, i % 12 + 1 as branch_id, product_id, currency_code, status, {_at('i % 365')} as opened_at,
        if(status = 'CLOSED', {_at('i % 365 + 500')}, null) as closed_at, if(status = 'DORMANT', {_at('-500')}, {_at('i % 365 + 300')}) as last_activity_at,
        if(product_id in (1, 3, 4), 100000L, 0L) as overdraft_limit_minor, if(i % 9 = 0, concat('EXT-TEST-', {_pad('i', 8)}), null) as external_reference,
        concat(left(account_reference, 8), '…', right(account_reference, 4)) as account_label, {_at('i % 365')} as updated_at
        from (select *, concat('GB00TEST', {_pad('i', 12)}) as account_reference from _account)"""
    s["account_holders"] = f"""select {_id('ACC', 'i')} as account_id, {_id('CUS', 'customer')} as customer_id, 'PRIMARY' as holder_role, if(i % 10 = 0, 60L, 100L) as ownership_percent,
          {_at('i % 365')} as added_at from _account
        union all select {_id('ACC', 'i')}, {_id('CUS', f'customer % {c} + 1')}, 'JOINT', 40L, {_at('i % 365 + 7')} from _account where i % 10 = 0"""
    s["beneficiaries"] = f"""select {_id('BEN', 'i')} as beneficiary_id, {_id('CUS', f'((i * 3 - 1) % {c} + 1)')} as owner_customer_id, concat('Test beneficiary ', {_pad('i', 5)}) as nickname,
        concat('Synthetic Recipient ', {_pad('i', 5)}) as beneficiary_name, concat('GB00DEST', {_pad('i', 12)}) as destination_reference, {_pick('GB DE FR US', 'i % 4')} as destination_country,
        {_currency('i')} as currency_code, {_at('i % 600')} as created_at, if(i % 5 = 0, null, {_at('i % 600 + 2')}) as verified_at, if(i % 5 = 0, 0L, 1L) as is_trusted from {_range(c // 3)}"""
    s["merchants"] = f"""select {_id('MER', 'i')} as merchant_id, concat('Synthetic Merchant ', {_pad('i', 4)}) as merchant_name, {_pad('(5000 + i) % 10000', 4)} as merchant_category_code,
        {_pick('GB FR DE US JP', 'i % 5')} as country_code, i % 5 + 1 as risk_tier, {_at('i')} as created_at from {_range(p.merchants)}"""
    s["journal_batches"] = f"""select i + 1 as batch_id, concat('BATCH-', date_format(d, 'yyyyMM')) as batch_reference, cast(d as string) as business_date, 'CORE_LEDGER' as source_system,
        'POSTED' as status, concat(d, 'T23:59:00Z') as posted_at, concat(d, 'T00:01:00Z') as created_at from (select *, {month} as d from {_range(MONTHS - 1, 0)})"""
    # a reversal repeats the transaction before it with the sides exchanged; k is the one whose formula holds
    s["_movement"] = f"""select m.*, if(i % 100 = 0, t.i, s.i) as source, if(i % 100 = 0, s.i, t.i) as target from (
          select i, k, {_currency('k')} as currency_code, 100 + k * 7919 % 2500000 as amount, i * 10357 % (730 * 86400) as after from (select i, if(i % 100 = 0, i - 1, i) as k from {_range(p.transactions)})) m
        join (select currency_code, count(*) as n from _account where status = 'ACTIVE' group by 1) using (currency_code)
        join (select i, currency_code, place from _account where status = 'ACTIVE') s on s.currency_code = m.currency_code and s.place = m.k * 17 % n
        join (select i, currency_code, place from _account where status = 'ACTIVE') t on t.currency_code = m.currency_code
          and t.place = if((m.k * 31 + 7) % n = m.k * 17 % n, (m.k * 31 + 8) % n, (m.k * 31 + 7) % n)""".replace("select m.*, if(i % 100", "select m.i, m.k, m.currency_code, m.amount, m.after, if(m.i % 100").replace(
        "if(i % 100 = 0, s.i, t.i) as target", "if(m.i % 100 = 0, s.i, t.i) as target")
    when = _at(seconds="after")
    kind = f"if(i % 100 = 0, 'REVERSAL', {_pick('TRANSFER CARD FEE INTEREST LOAN', 'i % 5')})"
    rapid = "i % 1000 in (1, 2, 3)"
    s["ledger_transactions"] = f"""select i as transaction_id, cast((substr(w, 1, 4) - 2024) * 12 + substr(w, 6, 2) - 1 as bigint) % 24 + 1 as batch_id, concat('TXN-', {_pad('i', 12)}) as transaction_reference,
        kind as transaction_type, currency_code, amount as amount_minor, w as booked_at, substr(w, 1, 10) as value_date,
        if({rapid}, 'Synthetic rapid movement pattern', concat('Synthetic ', lower(kind), ' ', {_pad('i', 8)})) as description, 'POSTED' as status, {_pick('MOBILE WEB BRANCH CARD BATCH', 'i % 5')} as channel,
        if(i % 17 = 0, 1L, 0L) as is_cross_border, if(i % 100 = 0, i - 1, null) as reversal_of_id,
        concat('{{"fixture":true,"pattern":"', if({rapid}, 'rapid_movement', 'ordinary'), '"}}') as metadata_json from (select *, {when} as w, {kind} as kind from _movement)"""
    s["ledger_entries"] = f"""select (i - 1) * 2 + side as entry_id, i as transaction_id, account_id, signed as amount_minor, if(signed < 0, 'DEBIT', 'CREDIT') as entry_side, side as running_sequence,
        {when} as posted_at, unhex(substr(sha2(concat_ws(':', i, side, account_id, signed), 256), 1, 32)) as integrity_hash from (
        select i, after, e.* from _movement lateral view explode(array(named_struct('side', 1L, 'account_id', {_id('ACC', 'source')}, 'signed', -amount),
          named_struct('side', 2L, 'account_id', {_id('ACC', 'target')}, 'signed', amount))) x as e)"""
    s["payment_instructions"] = f"""select {_id('PAY', 'm.i', 12)} as payment_id, {_id('ACC', 'source')} as source_account_id, beneficiary_id, m.i as transaction_id, amount as requested_amount_minor,
        m.currency_code as requested_currency_code, if(m.i % 17 = 0, 'SWIFT', 'INTERNAL') as payment_method, 'SETTLED' as payment_status, {_at(seconds='after - 300')} as requested_at, {when} as settled_at,
        cast(null as string) as failure_reason from _movement m join _account a on a.i = source
        left join (select owner_customer_id, min(beneficiary_id) as beneficiary_id from beneficiaries group by 1) b on owner_customer_id = {_id('CUS', 'a.customer')} where m.i % 4 = 0"""
    s["_card"] = "select (r - 1) div 3 + 1 as i, account, customer, currency_code from (select i as account, customer, currency_code, row_number() over (order by i) as r from _account where status = 'ACTIVE') where r % 3 = 1"
    s["cards"] = f"""select {_id('CRD', 'i')} as card_id, {_id('ACC', 'account')} as account_id, {_id('CUS', 'customer')} as customer_id, concat('tok_test_', {_pad('i', 12)}) as card_token,
        {_pad('i % 10000', 4)} as last_four, {_pick('DEBIT CREDIT VIRTUAL', 'i % 3')} as card_type, if(i % 101 = 0, 'BLOCKED', 'ACTIVE') as status, '2024-02-01' as issued_at, '2029-02-28' as expires_on,
        500000 + i % 10 * 100000 as spending_limit_minor from _card"""
    s["card_authorizations"] = f"""select {_id('AUT', 'n', 10)} as authorization_id, {_id('CRD', 'i')} as card_id, {_id('MER', f'(n % {p.merchants} + 1)')} as merchant_id, n % {p.transactions} + 1 as transaction_id,
        500 + n * 313 % 75000 as amount_minor, currency_code, if(n % 29 = 0, 'DECLINED', 'APPROVED') as decision, if(n % 29 = 0, '05', '00') as response_code, {_at(minutes='n * 73')} as authorized_at,
        unhex(substr(sha2(concat('device-', n), 256), 1, 24)) as device_fingerprint, n % 2 as is_card_present from (select *, explode(array(i * 2 - 1, i * 2)) as n from _card)"""
    s["fx_rates"] = f"""select base_currency_code, quote_currency_code, cast({month} as string) as rate_date, rate + i * 317 as rate_micros, 'SYNTHETIC_REFERENCE' as source
        from {_range(MONTHS - 1, 0)} join ({_values(RATES, 'base_currency_code, quote_currency_code, rate')})"""
    s["_loan"] = f"""select i, (i * 7 - 1) % {c} + 1 as customer, case when i % 11 = 0 then 'DELINQUENT' when i % 17 = 0 then 'PAID' else 'CURRENT' end as status,
        500000 + i * 110003 % 5000000 as principal, make_date(2024, cast(i % 12 + 1 as int), 1) as begun from {_range(max(20, c // 10))}"""
    s["loans"] = f"""select {_id('LOAN', 'i')} as loan_id, {_id('CUS', 'customer')} as customer_id, {_id('ACC', 'customer')} as disbursement_account_id, principal as principal_minor,
        {_currency('customer')} as currency_code, 350 + i % 800 as annual_rate_bps, 12L as term_months, cast(begun as string) as originated_on, cast(begun + 365 as string) as maturity_on, status,
        concat('{{"type":"synthetic_guarantee","value_minor":', principal * 2, '}}') as collateral_json from _loan"""
    s["loan_installments"] = f"""select {_id('LOAN', 'i')} as loan_id, n as installment_number, cast(due as string) as due_on, part as principal_due_minor, interest as interest_due_minor,
          case state when 'PAID' then part + interest when 'LATE' then (part + interest) div 4 else 0L end as paid_minor, if(state = 'PAID', concat(due, 'T12:00:00Z'), null) as paid_at, state as installment_status
        from (select *, case when status = 'DELINQUENT' and n in (9, 10, 11) then 'LATE' when due < date'2025-01-01' or status = 'PAID' then 'PAID' else 'DUE' end as state from (
          select *, date_add(begun, cast(30 * n as int)) as due, principal div 12 as part, principal * 5 div 12000 as interest from (select *, explode(sequence(1L, 12L)) as n from _loan)))"""
    status = _pick("OPEN INVESTIGATING CLOSED ESCALATED", "i % 4")
    s["_alert"] = f"select i, (i * 47 - 1) % {c} + 1 as customer, {status} as status from {_range(max(20, c // 50))}"
    s["aml_alerts"] = f"""select {_id('AML', 'i')} as alert_id, {_id('CUS', 'customer')} as customer_id, {_id('ACC', 'customer')} as account_id,
        {_pick('STRUCTURING RAPID_MOVEMENT SANCTIONS UNUSUAL_VALUE NEW_BENEFICIARY', 'i % 5')} as alert_type, {_pick('LOW MEDIUM HIGH CRITICAL', 'i % 4')} as severity, status as alert_status, 55 + i % 46 as score,
        {_at('i * 3')} as opened_at, if(status = 'CLOSED', {_at('i * 3 + 5')}, null) as closed_at, if(status = 'CLOSED', 'FALSE_POSITIVE', null) as disposition, 'fixture-rule-v1' as rule_version from _alert"""
    s["aml_alert_transactions"] = f"""select {_id('AML', 'i')} as alert_id, (i * 1000 + o) % {p.transactions} + 1 as transaction_id, 'Synthetic linked activity' as match_reason, 60 + o * 10 as contribution_score
        from (select *, explode(array(0L, 1L, 2L)) as o from _alert)"""
    s["audit_events"] = f"""select i as audit_event_id, if(i % 2 = 1, 'CUSTOMER', 'ACCOUNT') as entity_type, if(i % 2 = 1, {_id('CUS', f'(i % {c} + 1)')}, {_id('ACC', f'(i % {a} + 1)')}) as entity_id,
        'SYNTHETIC_REVIEW' as action, concat('fixture-user-', {_pad('i % 10', 2)}) as actor, {_at(minutes='i * 19')} as occurred_at, concat('{{"fixture":true,"sequence":', i, '}}') as changes_json,
        {_id('COR', 'i')} as correlation_id, concat('192.0.2.', i % 250 + 1) as source_ip from {_range(p.audits)}"""
    return s


VIEWS = {
    "v_account_balances": """select a.account_id, a.account_reference, a.currency_code, a.status, coalesce(balance, 0) as balance_minor, last_posted_at from accounts a
        left join (select account_id, sum(amount_minor) as balance, max(posted_at) as last_posted_at from ledger_entries group by 1) e on e.account_id = a.account_id""",
    "v_customer_account_summary": """select c.customer_id, c.display_name, c.risk_rating, count(distinct h.account_id) as account_count,
        coalesce(sum(if(h.holder_role = 'PRIMARY', b.balance_minor, 0)), 0) as primary_balance_minor, max(b.last_posted_at) as last_activity_at from customers c
        left join account_holders h on h.customer_id = c.customer_id left join v_account_balances b on b.account_id = h.account_id group by 1, 2, 3""",
    "v_monthly_cash_flow": """select *, lag(net_flow_minor) over (partition by account_id order by posting_month) as previous_month_net_minor from (
        select *, inflow_minor - outflow_minor as net_flow_minor from (select account_id, substr(posted_at, 1, 7) as posting_month, sum(greatest(amount_minor, 0)) as inflow_minor,
        -sum(least(amount_minor, 0)) as outflow_minor from ledger_entries group by 1, 2))""",
    "v_open_aml_alerts": """select a.alert_id, a.severity, a.alert_status, a.alert_type, a.customer_id, c.display_name, a.account_id, a.score, a.opened_at,
        count(l.transaction_id) as matched_transaction_count, coalesce(sum(t.amount_minor), 0) as matched_amount_minor from aml_alerts a left join customers c on c.customer_id = a.customer_id
        left join aml_alert_transactions l on l.alert_id = a.alert_id left join ledger_transactions t on t.transaction_id = l.transaction_id
        where a.alert_status in ('OPEN', 'INVESTIGATING', 'ESCALATED') group by 1, 2, 3, 4, 5, 6, 7, 8, 9""",
    "v_loan_arrears": """select l.loan_id, l.customer_id, c.display_name, l.disbursement_account_id, a.branch_id, l.currency_code, late_installment_count, arrears_minor, oldest_late_due_on from loans l
        join customers c on c.customer_id = l.customer_id join accounts a on a.account_id = l.disbursement_account_id join (
        select loan_id, count(*) filter (where installment_status = 'LATE') as late_installment_count,
          coalesce(sum(if(installment_status = 'LATE', principal_due_minor + interest_due_minor - paid_minor, 0)), 0) as arrears_minor,
          min(if(installment_status = 'LATE', due_on, null)) as oldest_late_due_on from loan_installments group by 1) i on i.loan_id = l.loan_id"""}


def build(spark: SparkSession, profile: str = "small") -> dict[str, DataFrame]:
    """Register all tables and views as temporary views and return the tables."""
    out = {}
    for name, sql in statements(PROFILES[profile]).items():
        df = spark.sql(sql)
        df.createOrReplaceTempView(name)
        if name in KEYS:
            out[name] = df
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    return out


def ordered_digest(df: DataFrame, key: str) -> tuple[int, str]:
    """(rows, sha256) over the rows in key order, each a compact ASCII JSON array and a
    newline. Rows stream through the driver one at a time; for large tables use the
    order-free digest instead."""
    digest, count = hashlib.sha256(), 0
    for row in df.orderBy(*[k.strip() for k in key.split(",")]).toLocalIterator():
        values = [{"blob": bytes(v).hex()} if isinstance(v, (bytes, bytearray)) else v for v in row]
        digest.update(json.dumps(values, separators=(",", ":")).encode() + b"\n")
        count += 1
    return count, digest.hexdigest()
