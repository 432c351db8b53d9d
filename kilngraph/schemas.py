"""Schemas of files and tables, as DDL."""

TRIPLE_FILE = "subject string, relation string, object string, context string, confidence double, data_type string, year string, source_file string, page_num int, chunk_id string, table_id string"
RAW_TRIPLE = f"seq long, {TRIPLE_FILE}"
ALIAS = "category string, standard string, alias string, ord int"
CHUNK = "struct<chunk_id:string,content:string,page_num:int,source_file:string>"
TABLE = "struct<table_id:string,page_num:int,headers:array<string>,rows:array<array<string>>,markdown:string,row_count:int,col_count:int,source_file:string,context:string>"
INTERMEDIATE = f"source_file string, chunks array<{CHUNK}>, tables array<{TABLE}>"
TRAINING = "text string, triples array<struct<subject:string,relation:string,object:string,context:string,confidence:double>>"
