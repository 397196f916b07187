"""The words a ledger uses.

Fixed values: these strings are data. Rows carry them and reports group by them, so they are kept as they
appear in the bank's own exports and in the category scheme. Pass a changed copy (``dataclasses.replace``)
for another bank, other accounts or another scheme.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Vocabulary:
    debit: str = "Af"
    credit: str = "Bij"

    # Card statement types.
    collection_type: str = "Incasso"
    payment_type: str = "Betaling"
    costs_type: str = "Kosten"

    # Categories that steer classification.
    internal_category: str = "Interne overboeking"
    income_category: str = "Inkomsten"
    settlement_pair: tuple[str, str] = ("Overige uitgaven", "creditcard")
    repayment_pair: tuple[str, str] = ("Aflossing", "creditcard")
    default_debit_pair: tuple[str, str] = ("Overige uitgaven", "overig")
    default_credit_pair: tuple[str, str] = ("Inkomsten", "overig")
    deposit_sub: str = "sparen"
    withdrawal_sub: str = "van spaarrekening"
    salary_sub: str = "salaris"
    other_sub: str = "overig"
    charging_subs: tuple[str, ...] = ("laadvergoeding", "laadpaal")

    # Pairs that may be chosen even when no row carries them yet.
    extra_pairs: tuple[tuple[str, str], ...] = (
        ("Vervoer", "bekeuringen"),
        ("Vervoer", "taxi"),
        ("Educatie", "schoolbijdrage"),
        ("Aflossing", "creditcard"),
        ("Inkomsten", "ERE"),
        ("Huishouden", "glazenwassers"),
    )

    # Subcategories that are income in their own right, not a shop's refund booked as income.
    real_income_subs: tuple[str, ...] = (
        "salaris",
        "belastingteruggaaf",
        "kinderbijslag",
        "toeslagen",
        "bijdrage opa",
        "bijdrage kado",
        "uit bouwdepot",
        "crypto verkoop",
        "laadvergoeding",
    )

    # Accounts.
    account_prefix: str = "Rekening "
    card_account: str = "Rekening A"
    own_accounts: tuple[str, ...] = ("Rekening A", "Rekening B")
    saving_counterparts: tuple[str, ...] = ("spaarrekening", "Oranje Spaarrekening")

    # Merchants too general to learn a category from.
    denied_merchants: tuple[str, ...] = ("persoon", "spaarrekening")
    denied_merchant_pattern: str = r"^ing(\s+bank(\s+nv)?)?$"

    surname_placeholder: str = "<geanonimiseerd>"

    # Status and tone words of an import preview.
    status_new: str = "nieuw"
    status_duplicate: str = "dubbel"
    status_error: str = "fout"
    tone_sure: str = "sure"
    tone_doubt: str = "doubt"
    source_rule: str = "regel"
    source_text: str = "text"
    source_fallback: str = "fallback"

    @property
    def charge_types(self) -> tuple[str, str]:
        return (self.payment_type, self.costs_type)

    @property
    def saving_subs(self) -> tuple[str, str]:
        return (self.deposit_sub, self.withdrawal_sub)

    def chart_accounts(self, selected: str | None = None) -> tuple[str, ...]:
        """The selected account alone, else the card account followed by the other own accounts."""
        if selected:
            return (selected,)
        first = [a for a in (self.card_account,) if a in self.own_accounts]
        rest = dict.fromkeys(a for a in self.own_accounts if a != self.card_account)
        return (*first, *rest)


DEFAULT = Vocabulary()

# Flow kinds, as classification assigns them.
INTERNAL, SETTLEMENT, SAVING = "internal", "cc_settlement", "saving"
INCOME, REFUND, EXPENSE, UNCLASSIFIED = "income", "refund", "expense", "unclassified"

# Moves between own accounts: left out of review, memory and the vector index.
STRUCTURAL_KINDS = (INTERNAL, SETTLEMENT)

# Which flow kinds each transaction list shows.
LIST_KINDS = {
    "spend": (EXPENSE, REFUND),
    "refund": (REFUND,),
    "saving": (SAVING,),
    "internal": (INTERNAL,),
    "income": (INCOME,),
}
