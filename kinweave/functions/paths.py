"""Hops, evidence and readable paths."""
from pyspark.sql import Column, functions as F

HOP_TYPE = "struct<frm:string,to:string,edge:string,attrs:map<string,string>>"
EVIDENCE_TYPE = "struct<table:string,pk:bigint,source:string,report_period:string,raw:map<string,string>>"


#: Attributes that hops of the rules may have, and hops that hold them as fields in place of a map: nothing is built or filtered per row.
ATTRS = ("ratio", "rank", "period", "source", "title", "title_class", "effective_ratio")
FLAT_HOP_TYPE = f"struct<frm:string,to:string,edge:string,attrs:struct<{','.join(f'{a}:string' for a in ATTRS)}>>"


def _text(v):
    return (v if isinstance(v, Column) else F.lit(v)).cast("string")


def _attr_map(attrs):
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), _text(v))]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def make_hop(frm, to, edge, **attrs) -> Column:
    return F.struct(_text(frm).alias("frm"), _text(to).alias("to"), _text(edge).alias("edge"),
                    _attr_map(attrs).alias("attrs")).cast(HOP_TYPE)


def flat_hop(frm, to, edge, **attrs) -> Column:
    """As make_hop, with a field for each attribute; absent ones are null."""
    fields = F.struct(*[_text(attrs.get(a)).alias(a) for a in ATTRS])
    return F.struct(_text(frm).alias("frm"), _text(to).alias("to"), _text(edge).alias("edge"), fields.alias("attrs")).cast(FLAT_HOP_TYPE)


def text_hop(frm, to, edge, **attrs) -> Column:
    """As make_hop, but as the text that render_path makes of it: what is only shown needs no more."""
    ratio, title = _text(attrs.get("ratio")), _text(attrs.get("title"))
    extra = (F.when(ratio.isNotNull(), F.concat(F.lit(" ["), ratio, F.lit("%]")))
             .when(title.isNotNull(), F.concat(F.lit(" ["), title, F.lit("]"))).otherwise(""))
    return F.concat(_text(frm), F.lit(" -"), _text(edge), extra, F.lit("-> "), _text(to))


HOP_TYPES = {make_hop: HOP_TYPE, flat_hop: FLAT_HOP_TYPE, text_hop: "string"}


def with_attr_maps(path) -> Column:
    """Flat hops as make_hop gives them."""
    return F.transform(path, lambda h: make_hop(h["frm"], h["to"], h["edge"], **{a: h["attrs"][a] for a in ATTRS}))


def make_evidence(table, pk, source, report_period=None, **raw) -> Column:
    pk = pk if isinstance(pk, Column) else F.lit(pk)
    return F.struct(_text(table).alias("table"), pk.cast("bigint").alias("pk"), _text(source).alias("source"),
                    _text(report_period).alias("report_period"), _attr_map(raw).alias("raw")).cast(EVIDENCE_TYPE)


def render_path(path) -> Column:
    """Hops (either kind) joined by ' | ', each with its ratio or else its title in brackets."""
    path = F.col(path) if isinstance(path, str) else path

    def one(hop):
        ratio, title = hop["attrs"]["ratio"], hop["attrs"]["title"]
        extra = (F.when(ratio.isNotNull(), F.concat(F.lit(" ["), ratio, F.lit("%]")))
                 .when(title.isNotNull(), F.concat(F.lit(" ["), title, F.lit("]"))).otherwise(""))
        return F.concat(hop["frm"], F.lit(" -"), hop["edge"], extra, F.lit("-> "), hop["to"])

    return F.array_join(F.transform(path, one), " | ")


def shown_path(df, c="path") -> Column:
    """render_path of a column of df, whatever kind its hops are of."""
    kind = df.select(F.col(c).alias("p")).schema["p"].dataType.elementType
    return F.array_join(c, " | ") if kind.typeName() == "string" else render_path(F.col(c))
