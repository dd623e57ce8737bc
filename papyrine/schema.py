"""Schemas of documents and of what is extracted from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:float,y:float,width:float,height:float>"
PROVENANCE = f"struct<confidence:float,page:bigint,bbox:{BOX}>"
PART = f"struct<index:bigint,kind:string,text:string,provenance:{PROVENANCE}>"
PARTS = f"array<{PART}>"
STEP = "struct<step:string,engine:string,duration_ms:bigint,outputs:map<string,bigint>>"
STEPS = f"array<{STEP}>"
METADATA = "struct<stem:string,extension:string,label:string,mime_type:string,description:string,is_text:boolean,confidence:float,origin:string,hash:string>"
ERROR = "struct<kind:string,engine:string,message:string>"
OCR_BLOCK = f"struct<text:string,bbox:{BOX},confidence:float,kind:string>"
OCR_PAGE = f"struct<width:int,height:int,blocks:array<{OCR_BLOCK}>>"
LAYOUT_BLOCK = f"struct<label:string,confidence:float,bbox:{BOX},order:bigint>"
LAYOUT_PAGE = f"struct<width:int,height:int,blocks:array<{LAYOUT_BLOCK}>>"

PART_KINDS = ("caption", "footer", "heading", "list_item", "paragraph", "table", "text", "unknown")
STEP_KINDS = ("detection", "parsing", "recognition")


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def error(kind: str, engine: str | None = None, message: str | Column = "") -> Column:
    """An error struct; a bad row carries it and never fails the job."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(kind).alias("kind"), F.lit(engine).cast("string").alias("engine"), message.alias("message")).cast(ERROR)
