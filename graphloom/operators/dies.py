"""Typed rows from a table of debug-information entries (cu, goff, parent, ord, tag, attrs).

attrs holds each attribute's value as text; references are goffs. Problems that make a row unusable go to
errors(), one row each, instead of ending the run; such rows are left out of types().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, trees
from ..plans.fixpoint import cut

DIE = "cu bigint, goff bigint, parent bigint, ord int, tag string, attrs map<string,string>"
TARG = f"struct<k:string,const:bigint,tree:{trees.TYPE}>"
MEMBER = f"struct<offset:bigint,name:string,ty:{trees.TYPE},special:string,bit_bytes:bigint>"
SLOT = f"struct<idx:bigint,name:string,fn:array<{trees.TYPE}>>"
# Columns of a row of types, beside cu, goff and kind.
PAYLOAD = {
    "name": "string",
    "name_ns": names.SEGMENTS,
    "enclosing": names.SEGMENTS,
    "target": "bigint",
    "byte_size": "bigint",
    "base_goff": "bigint",
    "enumerators": "array<struct<name:string,value:bigint>>",
    "targs": f"array<{TARG}>",
    "members": f"array<{MEMBER}>",
    "vtable": f"array<{SLOT}>",
    "tree": trees.TYPE,
}
# Encoding, byte size, primitive.
ENCODINGS = [
    ("boolean", 1, "bool"),
    ("unsigned", 1, "u8"),
    ("unsigned_char", 1, "u8"),
    ("signed", 1, "i8"),
    ("signed_char", 1, "i8"),
    ("unsigned", 2, "u16"),
    ("signed", 2, "i16"),
    ("UTF", 2, "u16"),
    ("unsigned", 4, "u32"),
    ("signed", 4, "i32"),
    ("float", 4, "f32"),
    ("unsigned", 8, "u64"),
    ("signed", 8, "i64"),
    ("float", 8, "f64"),
    ("unsigned", 16, "u128"),
    ("signed", 16, "i128"),
    ("float", 16, "f128"),
    ("UTF", 4, "u32"),  # beside the reference's, which stops at it
]
# Tags of types.
TYPE_TAGS = ["structure_type", "class_type", "union_type", "enumeration_type", "unspecified_type", "typedef", "array_type", "const_type", "pointer_type", "reference_type", "restrict_type", "volatile_type", "subroutine_type", "ptr_to_member_type", "base_type", "rvalue_reference_type"]
RECORDS = ["structure_type", "class_type", "union_type"]
TEMPLATE_TAGS = ["template_type_parameter", "template_value_parameter"]
PACK = "GNU_template_parameter_pack"
VOID = next(p[3] for p in trees.PRIMS if p[0] == "void")


def text(attr: str) -> Column:
    return F.try_element_at("attrs", F.lit(attr))


def integer(attr: str) -> Column:
    return F.expr(f"try_cast(try_element_at(attrs, '{attr}') as bigint)")


def flag(attr: str) -> Column:
    return F.coalesce(text(attr).isin("1", "true"), F.lit(False))


def virtuality(strict: bool = False) -> Column:
    """Slot of a virtual function, null of others."""
    virtual = F.coalesce(text("virtuality").isin("virtual", "pure_virtual"), F.lit(False))
    slot = F.when(virtual, integer("vtable_elem_location"))
    if not strict:
        return slot
    bad = virtual != integer("vtable_elem_location").isNotNull()
    return F.when(bad, F.raise_error(F.lit("slot and virtuality disagree")).cast("bigint")).otherwise(slot)


def inlined() -> Column:
    return F.coalesce(text("inline").isin("inlined", "declared_inlined"), F.lit(False))


def type_entries(dies: DataFrame) -> DataFrame:
    return dies.where(F.col("tag").isin(TYPE_TAGS))


def children(dies: DataFrame, tags: list[str], child_tags: list[str] | None = None) -> DataFrame:
    """Children of the entries of these tags, with the parent's goff as parent; a self-join on parent."""
    parents = dies.where(F.col("tag").isin(tags)).select("cu", F.col("goff").alias("parent"))
    kids = dies if child_tags is None else dies.where(F.col("tag").isin(child_tags))
    return kids.join(parents, ["cu", "parent"], "left_semi")


def primitives(dies: DataFrame) -> DataFrame:
    """(cu, goff, prim) of base types; prim is null where no encoding fits."""
    known = dies.sparkSession.createDataFrame(ENCODINGS, "encoding string, byte_size bigint, prim string")
    rows = dies.where("tag = 'base_type'").select("cu", "goff", text("encoding").alias("encoding"), integer("byte_size").alias("byte_size"))
    return rows.join(F.broadcast(known), ["encoding", "byte_size"], "left").select("cu", "goff", "prim")


def namespaces(dies: DataFrame, limit: int = 1000) -> DataFrame:
    """(cu, goff, qualifier, namespace) of every entry below a unit: the way to it through types, functions and namespaces, and through namespaces alone.

    One round a level; blocks add nothing to the way.
    """
    seg = lambda k, s, linkage: F.struct(F.lit(k).alias("k"), F.when(F.lit(k).isin("Type", "Subprogram"), F.col("goff")).alias("goff"), s.alias("s"), linkage.alias("is_linkage"))
    none, no = F.array().cast(names.SEGMENTS), F.lit(False)
    space = F.when(text("name").isNull(), seg("Anonymous", F.lit(None).cast("string"), no)).otherwise(seg("Name", text("name"), no))
    linkage = text("linkage_name")
    own = F.when(F.col("tag") == "namespace", space).when(F.col("tag") == "subprogram", seg("Subprogram", F.coalesce(linkage, text("name")), linkage.isNotNull())).when(F.col("tag").isin(TYPE_TAGS) & text("name").isNotNull(), seg("Type", text("name"), no))
    add = lambda way, ok: F.when(ok & F.col("own").isNotNull(), F.array_append(way, F.col("own"))).otherwise(F.col(way))
    rows = cut(dies.withColumn("own", own.cast(names.SEGMENTS[6:-1])).select("cu", "goff", "parent", "tag", "own"))
    front = rows.where("tag = 'compile_unit'").select("cu", "goff", none.alias("qualifier"), none.alias("namespace"), none.alias("q"), none.alias("n"))
    levels = []
    for _ in range(limit):
        up = front.select("cu", F.col("goff").alias("parent"), F.col("q").alias("qualifier"), F.col("n").alias("namespace"))
        front = cut(rows.join(up, ["cu", "parent"]).select("cu", "goff", "qualifier", "namespace", add("qualifier", F.lit(True)).alias("q"), add("namespace", F.col("tag") == "namespace").alias("n")))
        if front.isEmpty():
            return reduce(DataFrame.union, levels) if levels else front.select("cu", "goff", "qualifier", "namespace")
        levels.append(front.select("cu", "goff", "qualifier", "namespace"))
    raise ValueError("entries nest too deep")


def namespaces_by_source(spaces: DataFrame) -> DataFrame:
    """(cu, ns, segments, clash): the first namespace of each C++ source; clash where others have it with other segments. Those through functions or anonymous ones are left out."""
    plain = ~F.exists("namespace", lambda n: n["k"].isin("Anonymous", "Subprogram")) & (F.size("namespace") > 0)
    rows = spaces.where(plain).withColumn("ns", names.namespace_source(F.col("namespace")))
    key = F.array_join(F.transform("namespace", lambda n: n["s"]), "\0")
    return rows.groupBy("cu", "ns").agg(F.min_by("namespace", "goff").alias("segments"), (F.count_distinct(key) > 1).alias("clash"))


def operands(dies: DataFrame, tags: list[str]) -> DataFrame:
    """(cu, goff, fn): return type or void, then the parameters' types; a single void parameter is none."""
    own = dies.where(F.col("tag").isin(tags)).select("cu", "goff", F.coalesce(integer("type"), F.lit(VOID)).alias("ret"))
    params = children(dies, tags, ["formal_parameter"]).select("cu", F.col("parent").alias("goff"), "ord", F.coalesce(integer("type"), F.lit(VOID)).alias("t"))
    params = params.groupBy("cu", "goff").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]).alias("ts"))
    ts = F.coalesce("ts", F.array().cast("array<bigint>"))
    ts = F.when((F.size(ts) == 1) & (ts[0] == VOID), F.array().cast("array<bigint>")).otherwise(ts)
    return own.join(params, ["cu", "goff"], "left").select("cu", "goff", F.transform(F.concat(F.array("ret"), ts), lambda g: trees.base(g)).alias("fn"))


def flat_sub(fn: Column) -> Column:
    return F.concat(F.flatten(fn), trees.token("SUB", None, F.size(fn)))


def dimensions(dies: DataFrame) -> DataFrame:
    """(cu, goff, n, found): product of an array's counts in order; a dimension without count makes it null, and a later count starts anew."""
    counts = children(dies, ["array_type"], ["subrange_type"]).select("cu", F.col("parent").alias("goff"), "ord", integer("count").alias("n"))
    rows = counts.groupBy("cu", "goff").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "n"))), lambda x: x["n"]).alias("ns"))
    fold = F.aggregate("ns", F.lit(None).cast("bigint"), lambda p, n: F.when(n.isNotNull(), F.coalesce(p, F.lit(1)) * n).cast("bigint"))
    return rows.select("cu", "goff", fold.alias("n"), F.lit(True).alias("found"))


def template_arguments(dies: DataFrame, limit: int = 1000) -> DataFrame:
    """(cu, goff, targs): template arguments of each entry in order, packs flattened."""
    rows = dies.where(F.col("tag").isin([*TEMPLATE_TAGS, PACK])).select("cu", "goff", "parent", "tag", "attrs", F.array("ord").alias("way"))
    packs = rows.where(F.col("tag") == PACK).select("cu", F.col("goff").alias("pack"), F.col("parent").alias("up"), F.col("way").alias("above"))
    rows = rows.where(F.col("tag") != PACK)
    for _ in range(limit):
        up = rows.join(packs, (rows.cu == packs.cu) & (rows.parent == packs.pack), "left").select(rows.cu, "goff", F.coalesce("up", "parent").alias("parent"), "tag", "attrs", F.when(F.col("up").isNull(), F.col("way")).otherwise(F.concat("above", "way")).alias("way"))
        up = cut(up)
        if up.join(packs, (up.cu == packs.cu) & (up.parent == packs.pack), "left_semi").isEmpty():
            break
        rows = up
    else:
        raise ValueError("packs nest too deep")
    value = integer("const_value")
    k = F.when(F.col("tag") == "template_type_parameter", "Type").when(value.isNotNull(), "Const").otherwise("StaticConst")
    arg = F.struct(k.alias("k"), F.when(k == "Const", value).alias("const"), F.when(k == "Type", trees.base(F.coalesce(integer("type"), F.lit(VOID)))).alias("tree")).cast(TARG)
    # the way is ordered as text of equal width, since arrays of one length compare in order but nested ones don't
    way = F.array_join(F.transform("way", lambda x: F.lpad(x.cast("string"), 12, "0")), ".")
    got = up.select("cu", F.col("parent").alias("goff"), F.struct(way.alias("way"), arg.alias("arg")).alias("x"))
    return got.groupBy("cu", "goff").agg(F.transform(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["way"] < b["way"], -1).when(a["way"] > b["way"], 1).otherwise(0)), lambda x: x["arg"]).alias("targs"))


def struct_members(dies: DataFrame, vfptr: str = "^_vptr", pointer_prim: str = "u64") -> DataFrame:
    """(cu, goff, members, clash) of structs: static members left out, bitfields at one offset collapsed to the last, ordered by offset with bases last, a base at another member's offset dropped.

    clash: the offset at which two members other than bases stand.
    """
    kids = children(dies, ["structure_type", "class_type"], ["member", "inheritance"]).where(~((F.col("tag") == "member") & flag("external")))
    special_name = F.coalesce(text("name").rlike(vfptr), F.lit(False)) & (F.col("tag") == "member")
    bits = integer("bit_size").isNotNull() & (F.col("tag") == "member")
    special = F.when(F.col("tag") == "inheritance", "Base").when(bits, "Bitfield").when(special_name, "Vfptr")
    ty = F.when(special_name, trees.prim(pointer_prim)).otherwise(trees.base(integer("type")))
    member = F.struct(F.when(special_name, F.lit(0)).otherwise(integer("data_member_location")).cast("bigint").alias("offset"), F.when(~special_name & (F.col("tag") == "member"), text("name")).alias("name"), ty.alias("ty"), special.alias("special"), F.when(bits, integer("byte_size")).alias("bit_bytes")).cast(MEMBER)
    rows = kids.select("cu", F.col("parent").alias("goff"), "ord", member.alias("m"))
    turn = Window.partitionBy("cu", "goff").orderBy("ord")
    after = F.lead("m").over(turn)
    rows = rows.withColumn("gone", F.coalesce((F.col("m.special") == "Bitfield") & (after["special"] == "Bitfield") & (after["offset"] == F.col("m.offset")), F.lit(False))).where(~F.col("gone"))
    place = Window.partitionBy("cu", "goff").orderBy("m.offset", F.coalesce(F.col("m.special") == "Base", F.lit(False)), "ord")
    same = F.coalesce(F.lag("m.offset").over(place) == F.col("m.offset"), F.lit(False))
    rows = rows.withColumn("same", same).withColumn("is_base", F.coalesce(F.col("m.special") == "Base", F.lit(False))).where(~(F.col("same") & F.col("is_base")))
    order = lambda a, b: F.when(a["m"]["offset"] < b["m"]["offset"], -1).when(a["m"]["offset"] > b["m"]["offset"], 1).when(a["is_base"] != b["is_base"], F.when(a["is_base"], 1).otherwise(-1)).when(a["ord"] < b["ord"], -1).otherwise(1)
    return rows.groupBy("cu", "goff").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "is_base", "ord")), order), lambda x: x["m"]).alias("members"), F.min(F.when(F.col("same"), F.col("m.offset"))).alias("clash"))


def union_members(dies: DataFrame) -> DataFrame:
    """(cu, goff, members) of unions: the first of each type, under the first name that one of its type has."""
    kids = children(dies, ["union_type"], ["member"]).select("cu", F.col("parent").alias("goff"), "ord", integer("type").alias("t"), text("name").alias("n"))
    first = kids.groupBy("cu", "goff", "t").agg(F.min("ord").alias("ord"), F.min_by("n", F.when(F.col("n").isNotNull(), F.col("ord"))).alias("n"))
    member = F.struct(F.lit(0).cast("bigint").alias("offset"), F.col("n").alias("name"), trees.base(F.col("t")).alias("ty"), F.lit(None).cast("string").alias("special"), F.lit(None).cast("bigint").alias("bit_bytes")).cast(MEMBER)
    rows = first.select("cu", "goff", "ord", member.alias("m"))
    order = lambda a, b: F.when(a["ord"] < b["ord"], -1).otherwise(1)
    return rows.groupBy("cu", "goff").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "m")), order), lambda x: x["m"]).alias("members"))


def slots(dies: DataFrame) -> DataFrame:
    """(cu, goff, vtable) of structs: slot, name and types of each virtual function, in the order of the entries."""
    fns = children(dies, ["structure_type", "class_type"], ["subprogram"]).withColumn("idx", virtuality()).where("idx is not null")
    fns = fns.select("cu", "goff", "parent", "ord", "idx", text("name").alias("name")).join(operands(dies, ["subprogram"]), ["cu", "goff"])
    slot = F.struct("idx", "name", "fn").cast(SLOT)
    rows = fns.select("cu", F.col("parent").alias("goff"), F.struct("ord", slot.alias("v")).alias("x"))
    order = lambda a, b: F.when(a["ord"] < b["ord"], -1).otherwise(1)
    return rows.groupBy("cu", "goff").agg(F.transform(F.array_sort(F.collect_list("x"), order), lambda x: x["v"]).alias("vtable"))


def types(dies: DataFrame, abandon: list[str] = (), vfptr: str = "^_vptr", pointer_prim: str = "u64") -> DataFrame:
    """Rows of types: kinds prim, typedef, alias, tree, enum, enum_decl, union, union_decl, struct, struct_decl.

    abandon: patterns of typedef names that become plain aliases, as typedefs inside functions do.
    """
    dies = cut(dies)
    spaces = namespaces(dies).select("cu", "goff", F.col("qualifier").alias("name_ns"), F.col("namespace").alias("enclosing"))
    typed = dies.where(F.col("tag").isin(TYPE_TAGS)).join(spaces, ["cu", "goff"], "left")
    own, target = text("name"), integer("type")
    plain = names.untemplated(own)
    null = lambda kind: F.lit(None).cast(kind)

    def rows(df: DataFrame, kind: Column, **cols: Column) -> DataFrame:
        return df.select("cu", "goff", kind.alias("kind"), *[cols.get(c, null(t)).cast(t).alias(c) for c, t in PAYLOAD.items()])

    local = F.exists("name_ns", lambda n: n["k"] == "Subprogram")
    dropped = reduce(lambda a, b: a | b, [own.rlike(r) for r in abandon], F.lit(False))
    typedefs = typed.where("tag = 'typedef'")
    gone = F.coalesce(dropped | local, F.lit(False))
    out = [rows(typedefs, F.when(gone, "alias").otherwise("typedef"), name=F.when(~gone, own), name_ns=F.when(~gone, F.col("name_ns")), target=F.coalesce(target, F.lit(VOID)))]
    out.append(rows(typed.where(F.col("tag").isin("const_type", "volatile_type", "restrict_type")), F.lit("alias"), target=F.coalesce(target, F.lit(VOID))))
    pointers = typed.where(F.col("tag").isin("pointer_type", "reference_type", "rvalue_reference_type"))
    out.append(rows(pointers, F.lit("tree"), tree=trees.ptr(trees.base(F.coalesce(target, F.lit(VOID))))))
    arrays = typed.where("tag = 'array_type'").join(dimensions(dies), ["cu", "goff"]).where(target.isNotNull())
    out.append(rows(arrays, F.lit("tree"), tree=F.when(F.col("n").isNull(), trees.ptr(trees.base(target))).otherwise(trees.array(trees.base(target), F.col("n")))))
    subs = typed.where("tag = 'subroutine_type'").join(operands(dies, ["subroutine_type"]), ["cu", "goff"])
    out.append(rows(subs, F.lit("tree"), tree=flat_sub(F.col("fn"))))
    pointee = operands(dies, ["subroutine_type"]).select("cu", F.col("goff").alias("p"), F.col("fn"))
    members = typed.where("tag = 'ptr_to_member_type'").withColumn("p", target).join(pointee, ["cu", "p"], "left")
    owner = integer("containing_type")
    method = F.concat(F.flatten("fn"), trees.token("PTMF", owner, F.size("fn")))
    out.append(rows(members, F.lit("tree"), tree=F.when(F.col("fn").isNotNull(), method).otherwise(trees.ptmd(owner, null("string"), trees.base(F.coalesce(target, F.lit(VOID)))))))
    prim = primitives(dies).where("prim is not null").join(typed.select("cu", "goff"), ["cu", "goff"])
    known = dies.sparkSession.createDataFrame([(p[0], p[3]) for p in trees.PRIMS], "prim string, g bigint")
    prim = prim.join(F.broadcast(known), "prim")
    out.append(rows(prim, F.lit("alias"), target=F.col("g")))
    out.append(rows(typed.where("tag = 'unspecified_type'").where(own == "decltype(nullptr)"), F.lit("alias"), target=F.lit(next(p[3] for p in trees.PRIMS if p[0] == pointer_prim))))

    enums = typed.where("tag = 'enumeration_type'")
    marks = children(dies, ["enumeration_type"], ["enumerator"]).select("cu", F.col("parent").alias("goff"), F.struct("ord", text("name").alias("name"), integer("const_value").alias("value")).alias("x"))
    marks = marks.groupBy("cu", "goff").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias("enumerators"))
    defined, declared = ~flag("declaration"), flag("declaration")
    some = F.coalesce("enumerators", F.array().cast(PAYLOAD["enumerators"]))
    out.append(rows(enums.where(defined).join(marks, ["cu", "goff"], "left"), F.lit("enum"), name=own, name_ns=F.col("name_ns"), byte_size=integer("byte_size"), base_goff=F.when(integer("byte_size").isNull(), target), enumerators=some))
    records = typed.where(F.col("tag").isin(RECORDS))
    family = F.when(F.col("tag") == "union_type", "union").otherwise("struct")
    for rs, kind in ((enums, F.lit("enum_decl")), (records, F.concat(family, F.lit("_decl")))):
        out.append(rows(rs.where(declared), kind, name=own, name_ns=F.col("name_ns"), enclosing=F.col("enclosing")))
    full = records.where(defined).join(template_arguments(dies), ["cu", "goff"], "left")
    laid = struct_members(dies, vfptr, pointer_prim).where("clash is null").drop("clash").union(union_members(dies))
    bad = struct_members(dies, vfptr, pointer_prim).where("clash is not null").select("cu", "goff")
    full = full.join(laid, ["cu", "goff"], "left").join(slots(dies), ["cu", "goff"], "left").join(bad, ["cu", "goff"], "left_anti")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(PAYLOAD[c]))
    out.append(rows(full, family, name=plain, name_ns=F.col("name_ns"), byte_size=integer("byte_size"), targs=empty("targs"), members=empty("members"), vtable=empty("vtable")))
    return reduce(DataFrame.unionByName, out)


def errors(dies: DataFrame, vfptr: str = "^_vptr") -> DataFrame:
    """(stage, cu, goff, code, msg) of entries that types() leaves out."""
    row = lambda df, code, msg: df.select(F.lit("load").alias("stage"), "cu", "goff", F.lit(code).alias("code"), msg.cast("string").alias("msg"))
    arrays = dies.where("tag = 'array_type'").join(dimensions(dies), ["cu", "goff"], "left")
    virtual = children(dies, ["union_type"], ["subprogram"]).where(virtuality().isNotNull()).select("cu", F.col("parent").alias("goff"))
    odd = dies.where("tag = 'subprogram'").where(F.coalesce(text("virtuality").isin("virtual", "pure_virtual"), F.lit(False)) != integer("vtable_elem_location").isNotNull())
    return reduce(DataFrame.union, [
        row(primitives(dies).where("prim is null"), "primitive", F.lit("unknown encoding or size")),
        row(dies.where((F.col("tag") == "unspecified_type") & ~F.coalesce(text("name") == "decltype(nullptr)", F.lit(False))), "unspecified", text("name")),
        row(arrays.where(integer("type").isNull() | F.col("found").isNull()), "array", F.lit("no element type or no dimension")),
        row(struct_members(dies, vfptr).where("clash is not null"), "layout", F.col("clash")),
        row(virtual, "union", F.lit("virtual function in a union")),
        row(odd, "slot", F.lit("slot and virtuality disagree")),
    ])


def inherited(dies: DataFrame, attr: str, limit: int = 1000) -> DataFrame:
    """(cu, goff, value): the attribute of the entry, else of its abstract origin, else of its specification, and so on through them."""
    rows = dies.select("cu", "goff", text(attr).alias("value"), integer("abstract_origin").alias("a"), integer("specification").alias("s"))
    at = cut(rows)
    for _ in range(limit):
        of = lambda c: at.select("cu", F.col("goff").alias(c), F.col("value").alias(f"{c}_value"))
        new = at.join(of("a"), ["cu", "a"], "left").join(of("s"), ["cu", "s"], "left")
        new = cut(new.select("cu", "goff", F.coalesce("value", "a_value", "s_value").alias("value"), "a", "s"))
        if new.where("value is not null").count() == at.where("value is not null").count():
            return new.select("cu", "goff", "value")
        at = new
    raise ValueError("origins nest too deep")


def functions(dies: DataFrame) -> DataFrame:
    """Symbols (cu, goff, link_name, ty, param_names, targs) of functions with a body: those with an address or inlined, declarations left out."""
    dies = cut(dies)
    link, kind = inherited(dies, "linkage_name").withColumnRenamed("value", "link_name"), inherited(dies, "type").withColumnRenamed("value", "ret")
    origin = dies.select("cu", F.col("goff").alias("o"), inlined().alias("of_origin"))
    own = dies.where("tag = 'subprogram'").where(~flag("declaration")).withColumn("o", integer("abstract_origin")).join(origin, ["cu", "o"], "left")
    own = own.where(text("low_pc").isNotNull() | inlined() | F.coalesce("of_origin", F.lit(False))).select("cu", "goff")
    own = own.join(link, ["cu", "goff"]).where("link_name is not null").join(kind, ["cu", "goff"])
    name, ty = inherited(dies, "name").withColumnRenamed("value", "n"), inherited(dies, "type").withColumnRenamed("value", "t")
    params = children(dies, ["subprogram"], ["formal_parameter"]).select("cu", "goff", "parent", "ord").join(name, ["cu", "goff"]).join(ty, ["cu", "goff"])
    params = params.groupBy("cu", F.col("parent").alias("goff")).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("n", F.lit("")).alias("n"), F.coalesce(F.col("t").cast("bigint"), F.lit(VOID)).alias("t")))).alias("ps"))
    ps = F.coalesce("ps", F.array().cast("array<struct<ord:int,n:string,t:bigint>>"))
    fn = F.concat(F.array(trees.base(F.coalesce(F.col("ret").cast("bigint"), F.lit(VOID)))), F.transform(ps, lambda p: trees.base(p["t"])))
    rows = own.join(params, ["cu", "goff"], "left").join(template_arguments(dies), ["cu", "goff"], "left")
    return rows.select("cu", "goff", "link_name", flat_sub(fn).alias("ty"), names.filled_parameters(F.transform(ps, lambda p: p["n"])).alias("param_names"), F.coalesce("targs", F.array().cast(f"array<{TARG}>")).alias("targs"))


def data(dies: DataFrame) -> DataFrame:
    """Symbols of variables with a linkage name; the type is the variable's or its specification's."""
    rows = dies.where("tag = 'variable'").where(text("linkage_name").isNotNull()).select("cu", "goff", text("linkage_name").alias("link_name"), integer("type").alias("t"), integer("specification").alias("s"))
    spec = dies.select("cu", F.col("goff").alias("s"), integer("type").alias("st"))
    rows = rows.join(spec, ["cu", "s"], "left").withColumn("t", F.coalesce("t", "st")).where("t is not null")
    return rows.select("cu", "goff", "link_name", trees.base(F.col("t")).alias("ty"), F.array().cast("array<string>").alias("param_names"), F.array().cast(f"array<{TARG}>").alias("targs"))


def qualified(dies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cu, goff, segments, base) of named entries with their qualifier, and (cu, goff) of those without one."""
    named = dies.where(text("name").isNotNull() & (F.col("tag") != "compile_unit")).select("cu", "goff", names.untemplated(text("name")).alias("base"))
    spaces = namespaces(dies).select("cu", "goff", F.col("qualifier").alias("segments"))
    return named.join(spaces, ["cu", "goff"]).select("cu", "goff", "segments", "base"), named.join(spaces, ["cu", "goff"], "left_anti").select("cu", "goff")
