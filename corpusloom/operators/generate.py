"""Documents rendered from tables: synthetic support texts, markdown, block rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, strip
from corpusloom.operators.chunking import split_at_punctuation

# Vocabularies of the synthetic support texts.
VOCABULARIES = {
    "system": (
        "order-service", "inventory-service", "payment-service", "promotion-service", "user-profile-service",
        "message-service", "gateway-service", "settlement-service", "refund-service", "coupon-service",
    ),
    "module": (
        "订单创建", "库存扣减", "优惠计算", "支付初始化", "消息通知", "退款处理", "用户画像", "风控校验",
        "结算汇总", "优惠券核销",
    ),
    "symptom": (
        "接口超时并伴随 RT 明显抖动", "高峰期错误率突然升高", "调用链偶发返回 50401", "线程池队列持续堆积",
        "用户反馈提交后长时间无响应", "接口成功率下降但网关正常", "缓存命中率下降后数据库压力升高",
        "日志里频繁出现重试和熔断记录",
    ),
    "cause": (
        "Redis 热 key 导致热点请求集中", "数据库锁等待拉长事务耗时", "线程池耗尽导致请求排队",
        "下游服务抖动放大上游超时", "消息发送同步阻塞主链路", "配置变更导致连接池参数不合理",
        "批量任务抢占资源影响在线流量", "缓存失效后回源流量瞬时放大",
    ),
    "action": (
        "优先检查线程池、Redis 热 key 和数据库锁等待", "先确认下游 RT，再看本服务队列长度和连接池状态",
        "必要时先降级非核心逻辑，保护主交易链路", "对热点接口增加限流和本地缓存兜底",
        "对慢查询和锁等待做重点排查", "通过调用链追踪确认瓶颈是否出在下游",
        "针对高峰期场景预热缓存并扩容线程池", "对同步消息改造成异步投递，降低主链路耦合",
    ),
    "path": (
        "/api/v1/orders", "/api/v1/inventory/deduct", "/api/v1/payments/init", "/api/v1/promotions/calculate",
        "/api/v1/refunds/create", "/api/v1/messages/send",
    ),
    "code": ("50401", "50402", "42901", "50031", "50311", "40027"),
}
# Texts of one synthetic document; {name:stride} picks from a vocabulary.
SUPPORT_TEMPLATES = (
    "故障概览：{system:3} 的 {module:5} 模块在巡检中暴露出问题。常见现象是{symptom:2}。该模块核心接口路径为 {path:7}，一旦异常通常会返回错误码 {code:11}。",
    "排查建议：当 {system:3} 的 {module:5} 触发错误码 {code:11} 时，{action:3}。如果问题发生在高峰期，应优先确认网关是否正常，再检查核心下游依赖。",
    "根因模式：历史案例显示，{system:3} 出现 {module:5} 异常时，高概率根因是{cause:2}。如果同时出现 {symptom:4}，基本可以判定需要重点查看依赖服务状态。",
    "接口说明：{module:5} 对外暴露接口 {path:7}。正常情况下返回 code=0；如果依赖链路抖动，可能出现 code={code:11}。调用方应避免无限重试，否则会进一步放大 {cause:6}。",
    "可复用经验：遇到 {system:3} 的 {module:5} 问题，不要只看应用日志。应同时检查 Redis、数据库、线程池和下游 RT。如果存在 {cause:8}，优先做限流、降级和容量回收。",
    "依赖说明：{system:3} 的 {module:5} 依赖 inventory-service、message-service 和 payment-service。当 {symptom:9} 时，通常意味着下游调用链出现了级联放大，可以结合 {action:10} 来缩小排查范围。",
    "监控策略：应对 {module:5} 的成功率、RT、线程池活跃数、连接池等待数和 Redis 命中率建立监控。一旦看到 {symptom:12} 与 {code:11} 同时出现，说明 {system:3} 可能已经进入退化状态。",
    "优化建议：为了降低 {system:3} 在 {module:5} 场景下的故障概率，建议引入缓存预热、熔断、异步化和热点隔离。特别是 {cause:13} 这类问题，必须在设计阶段预留缓冲手段。",
)


def pick(words: Sequence[str], index: Column, stride: int) -> Column:
    """Word number ``(index * stride + stride) mod n``."""
    place = F.pmod(index * stride + stride, F.lit(len(words))).cast("int")
    return F.element_at(F.array(*[F.lit(w) for w in words]), place + 1)


def fill_template(template: str, index: Column, vocabularies=VOCABULARIES) -> Column:
    """A template as a concatenation of its fixed parts and picked words."""
    import re

    parts = []
    for text, name, stride in re.findall(r"([^{]*)(?:\{(\w+):(\d+)\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(pick(vocabularies[name], index, int(stride)))
    return F.concat(*parts)


def synthetic_documents(
    ids: DataFrame, index: str = "doc_index", chunks_per_doc: int = 5,
    templates: Sequence[str] = SUPPORT_TEMPLATES, vocabularies=VOCABULARIES,
) -> DataFrame:
    """Chunk rows of one synthetic document per id, with running offsets."""
    if chunks_per_doc <= 0:
        raise ValueError("chunks_per_doc must be positive")
    i = F.col(index)
    texts = F.array(*[fill_template(t, i, vocabularies) for t in templates[:chunks_per_doc]])
    number = F.format_string("%03d", i)
    base = ids.select(
        i,
        F.concat(F.lit("synthetic-support-doc-"), number).alias("title"),
        F.concat(F.lit("synthetic://support-doc/"), number).alias("source"),
        texts.alias("_texts"),
    )
    # At most one entry per template, so the nested sum stays tiny.
    starts = F.transform(
        F.col("_texts"),
        lambda t, n: F.aggregate(F.slice(F.col("_texts"), F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x) + 1),
    )
    return (
        base.withColumn("_starts", starts)
        .select(index, "title", "source", F.posexplode(F.arrays_zip("_texts", "_starts")).alias("chunk_index", "c"))
        .select(
            index, "title", "source", F.lit("synthetic_support_doc").alias("doc_type"), "chunk_index",
            F.concat("title", F.lit("-chunk-"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            F.col("c._texts").alias("content"),
            F.col("c._starts").alias("start"),
            (F.col("c._starts") + F.length("c._texts")).alias("end"),
        )
    )


def render_markdown(title: Column | str, sections: Column | str) -> Column:
    """``# title`` and one ``## heading`` with its body per section, parted by blank lines.

    ``sections`` is an array of ``struct(heading, body)``.
    """
    parts = F.transform(_col(sections), lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["body"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), _col(title)), F.array_join(parts, "\n\n"))


# Section headings of look-alike documents.
BACKGROUND_HEADING = "背景"
DETAIL_HEADING = "说明"


def render_two_sections(title: Column | str, body: Column | str) -> Column:
    """Look-alike document: the first paragraph as background, the others as details."""
    body = _col(body)
    rest = F.array_join(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), "\n\n")
    sections = F.array(
        F.struct(F.lit(BACKGROUND_HEADING).alias("heading"), F.element_at(body, 1).alias("body")),
        F.struct(F.lit(DETAIL_HEADING).alias("heading"), rest.alias("body")),
    )
    return render_markdown(title, sections)


# Block code and line prefixes.
TEXT_BLOCK = 2
TITLE_PREFIX = "标题："
SECTION_PREFIX = "小节："


def block_rows(df: DataFrame, text: str = "text", max_length: int = 900) -> DataFrame:
    """Text blocks of a markdown document: one row per piece of a line, in order.

    Lines become ``标题：``/``小节：`` or plain text and are cut at punctuation.
    """
    keep = [c for c in df.columns if c != text]
    lines = df.select(*keep, F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("line_no", "_line"))
    body = strip("_line")
    prefixed = (
        F.when(body.startswith("# "), F.concat(F.lit(TITLE_PREFIX), strip(F.substring(body, F.lit(3), F.length(body)))))
        .when(body.startswith("## "), F.concat(F.lit(SECTION_PREFIX), strip(F.substring(body, F.lit(4), F.length(body)))))
        .otherwise(body)
    )
    return (
        lines.filter(body != "")
        .withColumn("_line", prefixed)
        .select(*keep, "line_no", F.posexplode(split_at_punctuation("_line", max_length)).alias("piece_no", "content"))
        .withColumn("block_type", F.lit(TEXT_BLOCK))
    )


def manifest_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Document facts with ``word_count``: characters without newlines."""
    return df.withColumn("word_count", F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))).drop(text)
