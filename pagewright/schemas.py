"""Schemas of pages, blocks, sentences and cache entries."""

from __future__ import annotations

RECT = "struct<x:double,y:double,w:double,h:double>"
SPAN = "struct<start_span:int,start_char:int,end_span:int,end_char:int>"
PAGE = (
    "paper_id string, page int, view_box array<double>, styles map<string, struct<font_family:string>>, "
    "text_items array<struct<run_id:bigint, str:string, matrix:array<double>, width:double, height:double, font_name:string, has_eol:boolean>>"
)
BLOCK = f"paper_id string, page int, block_idx int, block_id string, kind string, role string, level int, text string, size double, body_size double, n_lines int, first_line string, lines array<{RECT}>"
SENTENCE = f"paper_id string, page int, block_idx int, block_id string, role string, sent_idx int, sent_id string, text string, span {SPAN}, rects array<{RECT}>"
LINE = "paper_id string, page int, line_idx int, block_idx int, x0 double, x1 double, y double, size double, mono boolean, text string"
CACHE = "key string, translation string, t timestamp, shard string"
