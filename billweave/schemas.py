"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from billweave import fixed_values as fv

GOODS_ITEM = "struct<" + ",".join(f"{f}:string" for f in fv.GOODS_FIELDS) + ">"
GOODS_LIST = f"array<{GOODS_ITEM}>"
GOODS_JSON = "array<struct<" + ",".join(f"`{k}`:string" for k in fv.GOODS_KEYS) + ">>"

BLOCK = "struct<text:string,y:double,x:double,side:string>"
BLOCK_LIST = f"array<{BLOCK}>"

PARTY_FIELDS = [
    f"{party}_{part}"
    for party in ("buyer", "seller")
    for part in ("name", "tax_id", "address_phone", "bank_account")
]
HEADER_FIELDS = [
    "invoice_type", "invoice_code", "invoice_number", "invoice_date", "check_code",
    *PARTY_FIELDS,
    "total_amount_cn", "total_amount", "pretax_amount", "tax_amount",
]

# what a parser plug-in has to yield: one row per XML element, plus rows whose
# tag starts with '#' for archive entries and errors
NODES = (
    "rel_path string, entry string, entry_no int, node_no int, parent_no int, "
    "parent_tag string, ns string, tag string, attrs map<string,string>, text string, "
    "owners array<int>, ref_no int, filled_no int"
)
# owners: enclosing text objects, outermost first; ref_no and filled_no: place of an object
# reference among those below equal tags of its entry, with and without empty ones
TAG_ENTRY = "#entry"
TAG_ERROR = "#error"

SPANS = "rel_path string, page int, seq int, x double, y double, text string"
RECOGNISED = (
    "rel_path string, page int, seq int, text string, confidence double, "
    "bbox array<array<double>>"
)
