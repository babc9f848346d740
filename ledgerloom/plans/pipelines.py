"""The three flows end to end, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import chunking, context, layout, retrieval, sections, verify
from ledgerloom.plans import models
from ledgerloom.sources.config import Config


def filings_to_chunks(filings: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, tables, items, rejected) of raw submissions (columns of read_filings). Filings without a valid form are
    rejected, never fatal."""
    typed = filings.withColumn("form", F.coalesce(sections.form_from_text(F.col("raw_text")), F.col("filing_type")))
    good, bad = sections.split_by_validity(typed, "form")
    meta = ("ticker", "filing_type", "accession_number", "year")
    tables = sections.html_tables(good, "doc_id", "raw_text")
    items = sections.item_blocks(good.filter(F.col("form").startswith("10-K")), "doc_id", "raw_text")
    body = section_texts(good).join(good.select("doc_id", *meta), "doc_id")
    chunks = chunking.chunk_documents(body, "doc_id", "text", config.chunk_tokens, config.chunk_overlap, config.max_chunk_bytes, (*meta, "section", "section_title"))
    return chunks, tables, items, bad.select("doc_id", "reason")


def section_texts(filings: DataFrame) -> DataFrame:
    """doc_id, section, section_title, text, n_blocks: the narrative sections of filings (doc_id, form, raw_text)."""
    return sections.narrative_sections(sections.html_elements(filings, "doc_id", "raw_text", "form"))


def layout_to_chunks(elements: DataFrame, clippings: DataFrame, doc: str, page: str, pdf_name: Column, captioner=models.TitleCaption()) -> DataFrame:
    """Unified chunks of parsed pages. A clipping without a caption gets one from its kind and the first texts of its page
    first; clippings that still have none are left out, text is never lost."""
    e = elements.withColumnRenamed(page, "_page")
    c = layout.page_context(clippings.withColumnRenamed(page, "_page"), e, [doc, "_page"]).withColumnRenamed("_page", page)
    c = c.withColumn("caption", F.coalesce("caption", captioner.caption(F.col("kind"), F.col("context")))).drop("context")
    return layout.unified_chunks(elements, c, doc, page, pdf_name)


def valid_questions(questions: DataFrame) -> DataFrame:
    """Questions of blanks only, and null ones, are not asked."""
    return questions.filter(F.trim(F.coalesce("query", F.lit(""))) != "")


def answer_questions(questions: DataFrame, corpus: DataFrame, config: Config = Config(), embedder=models.HashedWords(), reranker=models.WordOverlap(), generator=models.Extractive(), judge=models.NoJudge()) -> DataFrame:
    """questions (query_id bigint, query, ticker?, year? INT) against corpus (chunk_id, text, ticker, year INT, v): answer,
    sources, num_chunks_retrieved and verification per question; blank questions are refused with an error column."""
    ok = valid_questions(questions)
    q = ok.withColumn("qv", embedder.embed(F.col("query")))
    found = retrieval.search(corpus, "chunk_id", "v", q, "query_id", "qv", config.top_k, on=["ticker", "year"])
    rows = found.join(corpus.select(F.col("chunk_id").alias("id"), "text", "ticker", "year"), "id").join(ok.select("query_id", "query"), "query_id")
    ranked = retrieval.rerank(rows, reranker.score(F.col("query"), F.col("text")) if config.rerank and reranker else None, cut=config.rerank_cut)
    order = "final_rank" if "final_rank" in ranked.columns else "rank"
    kept = context.within_budget(ranked, ["query_id"], order, "text", config.max_context_chars, context.source_header(F.col("ticker"), F.col("year"), F.col("id")))
    ctx = context.join_parts(kept, ["query_id"], order)
    src = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("r"), F.struct("ticker", "year", "score", F.col("id").alias("chunk_id"), F.col("text").alias("text")).alias("s")))), lambda x: x["s"])
    grouped = ranked.groupBy("query_id").agg(src.alias("sources"), F.count(F.lit(1)).alias("num_chunks_retrieved"))
    none = F.array().cast(grouped.schema["sources"].dataType.simpleString())
    all_q = ok.select("query_id", "query").join(grouped, "query_id", "left").join(ctx.select("query_id", "context"), "query_id", "left")
    all_q = all_q.withColumn("sources", F.coalesce("sources", none)).withColumn("num_chunks_retrieved", F.coalesce("num_chunks_retrieved", F.lit(0)))
    asked = context.prompt(F.col("query"), F.coalesce("context", F.lit("")))
    out = all_q.withColumn("answer", generator.answer(F.col("query"), asked, F.col("sources")))
    if not config.verify:
        return out.select("query_id", "answer", "sources", "num_chunks_retrieved")
    reply = verify.first_json_object(judge.reply(F.col("query"), F.col("answer"), F.col("context")))
    facts = verify.fact_check(reply, F.transform("sources", lambda s: s["chunk_id"]))
    result = verify.verification(F.col("answer"), F.transform("sources", lambda s: s["text"]), F.transform("sources", lambda s: F.struct(s["ticker"].alias("ticker"), s["year"].alias("year"))), facts, verify.judged_score(reply))
    return out.withColumn("verification", result).select("query_id", "answer", "sources", "num_chunks_retrieved", "verification")
