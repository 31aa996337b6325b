"""Schemas of the data model, as DDL."""

SEGMENTS = "array<struct<id:int,type:string,content:string,paragraph_index:int>>"
STEPS = "array<struct<index:int,score:double,hallucination:int,step_score:double>>"
RAW_PROBLEM = "problem string, solution string, answer string, difficulty double"
SEGMENTED = f"{RAW_PROBLEM}, segment_num int, segments {SEGMENTS}"
CASE = f"id bigint, difficulty double, score double, num_steps int, steps {STEPS}, problem string, answer string"
GENERATION_LOG = f"id bigint, difficulty double, gen_output array<string>, steps {STEPS}, final_total_score double"
SUMMARY = "num bigint, avg_score double"
DISTRIBUTION = "difficulty int, count bigint, percentage double"
