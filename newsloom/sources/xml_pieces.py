"""Records of XML documents that may be damaged, cut out before anything is parsed.

A document is split where a record's tag opens, and each piece is mended and
closed: bare ampersands, HTML entities and forbidden characters are mended in
place. If the mended pieces don't parse together, each is parsed for itself, and
one that still fails is rebuilt from its complete fields, so an error costs the
fields it touches and nothing else. All of it is column expressions; a document
stays one row.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.binding import let

#: The field that holds a piece's text when it can't be parsed.
DAMAGED = "_damaged"
#: The tag that every piece gets.
_PIECE = "piece__"
_XML_NAMES = ("amp", "lt", "gt", "quot", "apos")


def _escaped(value: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return value


def without_cdata(payload: Column) -> Column:
    """CDATA sections as escaped text, and comments gone: no mark-up hides in text any more."""

    def section(part: Column, i: Column) -> Column:
        inside = F.substring_index(part, "]]>", 1)
        rest = F.substring(part, F.length(inside) + 4, F.length(part))
        return F.when(i == 0, part).otherwise(F.concat(_escaped(inside), rest))

    plain = F.array_join(F.transform(F.split(payload, r"<!\[CDATA\[", -1), section), "")
    return F.regexp_replace(
        F.when(F.contains(payload, F.lit("<![CDATA[")), plain).otherwise(payload), r"(?s)<!--.*?-->", ""
    )


def mended(xml: Column) -> Column:
    """``xml`` with bare ``&`` and ``<`` escaped, HTML entities resolved, and characters gone that XML forbids."""
    table = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() if name not in _XML_NAMES for x in (name, chr(code))])

    def reference(part: Column, i: Column) -> Column:
        def known(name: Column) -> Column:
            rest = F.substring(part, F.length(name) + 2, F.length(part))
            code = F.when(
                F.startswith(name, F.lit("#x")), F.conv(F.substring(name, 3, 6), 16, 10).try_cast("int")
            ).otherwise(F.substring(name, 2, 7).try_cast("int"))
            allowed = code.isin(9, 10, 13) | code.between(0x20, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF)
            return (
                F.when(i == 0, part)
                .when(name.isin(*_XML_NAMES), F.concat(F.lit("&"), part))
                .when(F.startswith(name, F.lit("#")), F.when(allowed, F.concat(F.lit("&"), part)).otherwise(rest))
                .otherwise(F.coalesce(F.concat(F.try_element_at(table, name), rest), F.concat(F.lit("&amp;"), part)))
            )

        return let(F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});", 1), known)

    resolved = F.array_join(F.transform(F.split(xml, "&", -1), reference), "")
    odd = xml.rlike(rf"&(?!(?:{'|'.join(_XML_NAMES)});)")  # most texts have none
    bare = F.regexp_replace(F.when(odd, resolved).otherwise(xml), r"<(?![A-Za-z_/!?])", "&lt;")
    # References never resolve to a forbidden character, so the given text tells.
    strange = xml.rlike(r"[\x00-\x1f]") | F.contains(xml, F.lit("\ufffe")) | F.contains(xml, F.lit("\uffff"))
    return F.when(strange, F.regexp_replace(bare, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")).otherwise(bare)


def rebuilt(xml: Column, name: Column, fields: tuple[str, ...]) -> Column:
    """A record of the complete ``fields`` of ``xml``, mark-up inside them escaped and odd attributes dropped."""
    pattern = rf"(?is)<({'|'.join(fields)})(?=[\s/>])([^<>]*?)(?:/>|>(.*?)</\1\s*>)"
    attribute = r"""\s[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*')"""

    def field(found: Column) -> Column:
        part = lambda group: F.regexp_extract(found, pattern, group)
        attributes = F.array_join(F.regexp_extract_all(part(2), F.lit(attribute), F.lit(0)), "")
        inside = F.replace(F.replace(part(3), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat(F.lit("<"), part(1), attributes, F.lit(">"), inside, F.lit("</"), part(1), F.lit(">"))

    complete = F.array_join(F.transform(F.regexp_extract_all(xml, F.lit(pattern), F.lit(0)), field), "")
    return F.concat(F.lit("<"), name, F.lit(">"), complete, F.lit("</"), name, F.lit(">"))


def records(payload: Column, names: tuple[str, ...], roots: tuple[str, ...], schema: str, fields: tuple[str, ...]) -> Column:
    """The records called one of ``names`` in a document, and what lies around them.

    A struct of ``head`` (mark-up before and behind the records), ``open`` (the
    document's root is not closed) and ``records``, an array of structs: ``name`` of
    the tag, ``value`` parsed by ``schema`` (with the complete ones of ``fields``
    where the piece is damaged), and the flags ``mended``, ``unclosed`` and
    ``damaged``.
    """
    tags, parents = "|".join(names), "|".join(roots)
    fields_of = T.StructType.fromDDL(f"{schema}, {DAMAGED} STRING")
    whole_of = T.StructType().add(_PIECE, T.ArrayType(fields_of)).add(DAMAGED, T.StringType())
    said = {"columnNameOfCorruptRecord": DAMAGED}

    def mend(piece: Column) -> Column:
        """A piece under one tag name, closed and mended, with what was wrong with it."""
        name = F.regexp_extract(piece, r"^<([\w:.-]+)", 1)
        empty = piece.rlike(r"^<[^<>]*/>")

        def read(cut: Column) -> Column:
            body = F.regexp_replace(F.regexp_replace(cut[0], rf"(?is)</(?:{parents})\s*>.*$", ""), r"<[^<>]*$", "")

            def value(body: Column) -> Column:
                def said_of(xml: Column) -> Column:
                    renamed = F.concat(F.lit(f"<{_PIECE}"), F.substring(xml, F.length(name) + 2, F.length(xml)))
                    return F.struct(
                        name.alias("name"),
                        F.when(empty, F.lit(f"<{_PIECE}/>")).otherwise(F.concat(renamed, F.lit(f"</{_PIECE}>"))).alias("xml"),
                        (xml != body).alias("mended"),
                        ((F.size(cut) < 2) & ~empty).alias("unclosed"),
                        F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("tail"),
                    )

                return let(mended(body), said_of)

            return let(body, value)

        return let(F.split(piece, rf"(?i)</(?:{tags})\s*>", 2), read)

    def settled(piece: Column) -> Column:
        """The value of one piece parsed for itself, and whether it is damaged."""

        def chosen(first: Column) -> Column:
            damaged = first.isNull() | first[DAMAGED].isNotNull()
            again = F.from_xml(rebuilt(piece["xml"], F.lit(_PIECE), fields), fields_of, said)
            return F.struct(F.when(damaged, again).otherwise(first).alias("value"), damaged.alias("damaged"))

        return let(F.from_xml(piece["xml"], fields_of, said), chosen)

    def parsed(pieces: Column) -> Column:
        """All values: from one document if it parses whole, else piece by piece."""
        joined = F.concat(F.lit("<all>"), F.array_join(F.transform(pieces, lambda p: p["xml"]), ""), F.lit("</all>"))

        def chosen(whole: Column) -> Column:
            fine = whole[DAMAGED].isNull() & (F.size(whole[_PIECE]) == F.size(pieces))
            together = F.transform(whole[_PIECE], lambda v: F.struct(v.alias("value"), F.lit(False).alias("damaged")))
            return F.when(F.coalesce(fine, F.lit(False)), together).otherwise(F.transform(pieces, settled))

        return let(F.from_xml(joined, whole_of, said), chosen)

    def laid_out(text: Column) -> Column:
        first = text.rlike(rf"^(?i)<(?:{tags})[\s/>]")

        def split(parts: Column) -> Column:
            skip = F.when(first, 0).otherwise(1)
            pieces = F.transform(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0))), mend)

            def joined(pieces: Column) -> Column:
                def record(values: Column) -> Column:
                    def one(p: Column, i: Column) -> Column:
                        return F.struct(p["name"], values[i]["value"].alias("value"), p["mended"], p["unclosed"], values[i]["damaged"].alias("damaged"))

                    return F.transform(pieces, one)

                head = F.concat(F.when(first, "").otherwise(parts[0]), F.array_join(F.transform(pieces, lambda p: p["tail"]), ""))
                return F.struct(
                    head.alias("head"),
                    (~text.rlike(rf"(?is)</(?:{parents})\s*>\s*$")).alias("open"),
                    let(parsed(pieces), record).alias("records"),
                )

            return let(pieces, joined)

        return let(F.split(text, rf"(?i)(?=<(?:{tags})[\s/>])", -1), split)

    return let(without_cdata(F.coalesce(payload, F.lit(""))), laid_out)
