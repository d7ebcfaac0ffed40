"""Fixed inputs shared by the Spark views and their SQL counterparts."""

from docweft.schema import CalcDef, FieldDef, Rules, Template

FAILURE_MESSAGES = (
    "Docling parsing is disabled for .pdf documents.",
    "Docling PDF parsing produced no usable text, including OCR retry.",
    "Docling image parsing produced no usable text.",
    "Docling DOCX parsing produced no usable text.",
    "Docling HTML parsing produced no usable text.",
    "Docling failed to parse .pptx document: bad header",
    "Provider call failed for mock: timeout",
)

INVOICE = Template(
    name="Invoice Extraction",
    version="1.0.0",
    document_type="invoice",
    provider={"provider_type": "mock", "model": "mock-extractor"},
    fields=(
        FieldDef("vendor_name", "Vendor Name", "text", required=True, rules=Rules(allow_null=False)),
        FieldDef("total_amount", "Total Amount", "currency", required=True, rules=Rules(allow_null=False, currency="USD")),
        FieldDef("order_date", "Order Date", "date"),
        FieldDef("total_due", "Due Flag", "boolean", citation_required=False),
        FieldDef("item_count", "Item Count", "number", citation_required=False),
        FieldDef("ship_mode", "Ship Mode", "text", citation_required=False),
    ),
    calcs=(
        CalcDef("buffer_plus", "Buffer Plus", "number", "amount_with_buffer.amount + 5", ("amount_with_buffer",)),
        CalcDef("amount_with_buffer", "Amount With Buffer", "currency", "coalesce(total_amount.amount, 0) * 1.10",
                ("total_amount",), rules=Rules(allow_null=False, min=0)),
        CalcDef("days_open", "Days Open", "number", "days_between(order_date.value, DATE'2001-01-01')", ("order_date",)),
    ),
)

LINES = Template(
    name="Order Lines",
    version="2.0.0",
    document_type="statement",
    fields=(
        FieldDef("field_1", "Field 1", "currency", required=True, rules=Rules(regex=r"[1-4]\d*\.\d", max_length=7)),
        FieldDef("field_2", "Field 2", "currency", citation_required=False, rules=Rules(allow_null=False)),
        FieldDef("field_3", "Field 3", "currency", citation_required=False),
        FieldDef("field_4", "Field 4", "currency", required=True, rules=Rules(allow_null=False)),
        FieldDef("field_5", "Field 5", "currency", citation_required=False),
        FieldDef("field_9", "Field 9", "text", required=True, rules=Rules(allow_null=False)),
    ),
    calcs=(
        CalcDef("first_two", "First Two", "currency", "field_1.amount + field_2.amount", ("field_1", "field_2"),
                rules=Rules(max=100000.0)),
        CalcDef("share", "Share", "number", "field_3.amount / floor(field_5.amount / 50000)", ("field_3", "field_5"),
                on_missing_input="return_null"),
        CalcDef("quiet", "Quiet", "number", "field_3.amount / floor(field_5.amount / 50000)", ("field_3", "field_5"),
                on_divide_by_zero="return_null", on_missing_input="return_null", rules=Rules(min=5000.0)),
    ),
)
