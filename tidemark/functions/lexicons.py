"""Fixed values of the text operators: word lists, patterns, type tables.

They are parameters everywhere; these are the defaults.
"""

from __future__ import annotations

# Entity patterns.
ENTITY_PATTERNS = {
    "stock": [r"\b\d{6}\b", r"[A-Z]{2,6}", r"\d{6}\.(SH|SZ)", r"(沪|深)\d{6}"],
    "money": [r"\d+(?:\.\d+)?[万亿千百十]?[元块]", r"\$\d+(?:\.\d+)?[KMB]?", r"\d+(?:\.\d+)?美元", r"\d+(?:\.\d+)?人民币"],
    "percentage": [r"\d+(?:\.\d+)?%", r"百分之\d+(?:\.\d+)?", r"\d+(?:\.\d+)?个百分点"],
    "date": [r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}/\d{1,2}/\d{1,2}", r"\d{1,2}月\d{1,2}日", r"今天|昨天|明天|前天|后天"],
    "time_period": [r"\d+年", r"\d+个月", r"\d+天", r"\d+季度", r"上半年|下半年", r"第[一二三四]季度", r"近\d+[年月日]", r"过去\d+[年月日]"],
    "financial_metric": ["市盈率|PE", "市净率|PB", "净资产收益率|ROE", "总资产收益率|ROA", "毛利率", "净利率", "资产负债率", "流动比率", "速动比率"],
    "market_metric": ["上证指数|上证综指", "深证成指|深成指", "创业板指", "科创50", "沪深300", "中证500", "恒生指数", "纳斯达克指数", "道琼斯指数", "标普500"],
}
# Entity dictionary.
ENTITY_WORDS = {
    "company": "中国平安 招商银行 贵州茅台 腾讯控股 阿里巴巴 工商银行 建设银行 农业银行 中国银行 交通银行 中国石油 中国石化 中国移动 中国联通 中国电信 万科A 保利地产 华为技术 小米集团 字节跳动".split(),
    "industry": "银行业 保险业 证券业 房地产业 制造业 信息技术 医疗保健 消费品 能源 材料 工业 公用事业 电信服务 金融服务".split(),
    "concept": "人工智能 5G 新能源汽车 芯片 生物医药 云计算 大数据 物联网 区块链 虚拟现实 新基建 碳中和 数字货币 军工 航空航天".split(),
    "region": "北京 上海 广州 深圳 杭州 南京 成都 重庆 武汉 西安 天津 苏州 长三角 珠三角 京津冀 粤港澳大湾区".split(),
    "executive": "董事长 总经理 首席执行官 CEO CFO CTO 董事 监事 副总经理 总裁 副总裁".split(),
}
# Relation patterns (relation, pattern, confidence, both ways, source types, target types).
RELATION_PATTERNS = [
    ("owns", "(.+?)拥有(.+?)", 0.9, False, (), ()),
    ("controls", "(.+?)控制(.+?)", 0.9, False, (), ()),
    ("holds", "(.+?)持有(.+?)", 0.8, False, (), ()),
    ("invests_in", "(.+?)投资(.+?)", 0.8, False, (), ()),
    ("competes_with", "(.+?)与(.+?)竞争", 0.8, True, (), ()),
    ("cooperates_with", "(.+?)与(.+?)合作", 0.8, True, (), ()),
    ("supplies_to", "(.+?)向(.+?)供应", 0.8, False, (), ()),
    ("partners_with", "(.+?)与(.+?)建立伙伴关系", 0.9, True, (), ()),
    ("influences", "(.+?)影响(.+?)", 0.7, False, (), ()),
    ("causes", "(.+?)导致(.+?)", 0.8, False, (), ()),
    ("leads_to", "(.+?)引起(.+?)", 0.8, False, (), ()),
    ("belongs_to", "(.+?)属于(.+?)", 0.9, False, (), ()),
    ("is_part_of", "(.+?)是(.+?)的一部分", 0.9, False, (), ()),
    ("includes", "(.+?)包括(.+?)", 0.8, False, (), ()),
    ("works_for", "(.+?)在(.+?)工作", 0.9, False, ("person",), ("company", "organization")),
    ("manages", "(.+?)管理(.+?)", 0.8, False, ("person", "executive"), ()),
    ("founded_by", "(.+?)由(.+?)创立", 0.9, False, (), ("person",)),
    ("located_in", "(.+?)位于(.+?)", 0.9, False, (), ("region", "city", "country")),
    ("mentions", "(.+?)提到(.+?)", 0.6, False, (), ()),
    ("reports_on", "(.+?)报道(.+?)", 0.8, False, ("news",), ()),
]
# Relation keywords.
RELATION_KEYWORDS = {
    "owns": ["拥有", "持有", "所有", "占有"],
    "controls": ["控制", "掌控", "主导", "支配"],
    "invests_in": ["投资", "入股", "参股", "注资"],
    "competes_with": ["竞争", "对手", "竞争对手", "角逐"],
    "cooperates_with": ["合作", "协作", "联合", "携手"],
    "influences": ["影响", "作用", "冲击", "波及"],
    "causes": ["导致", "引起", "造成", "产生"],
    "belongs_to": ["属于", "隶属", "归属"],
    "located_in": ["位于", "坐落", "设在", "在"],
    "works_for": ["工作", "任职", "就职", "供职"],
    "manages": ["管理", "领导", "主管", "负责"],
    "mentions": ["提及", "提到", "涉及", "谈到"],
    "similar_to": ["相似", "类似", "相像", "近似"],
}
# Relation by the types of two near entities.
NEAR_RELATIONS = {
    ("company", "company"): "competes_with",
    ("company", "industry"): "belongs_to",
    ("company", "region"): "located_in",
    ("person", "company"): "works_for",
    ("executive", "company"): "manages",
    ("stock", "company"): "belongs_to",
    ("event", "company"): "affects",
    ("news", "company"): "mentions",
    ("concept", "company"): "related_to",
}
# Sentiment words.
POSITIVE = (
    "上涨 涨幅 涨停 大涨 暴涨 飙升 攀升 走高 冲高 突破 创新高 新高 历史新高 强势 强劲 坚挺 盈利 利润 增长 增收 营收 业绩 超预期 亮眼 优秀 出色 卓越 杰出 "
    "领先 第一 冠军 买入 增持 推荐 看好 乐观 积极 利好 机会 投资 价值 潜力 前景 发展 扩张 布局 活跃 热门 火爆 抢手 追捧 青睐 关注 受益 复苏 回暖 企稳 反弹 反转 转机"
).split()
NEGATIVE = (
    "下跌 跌幅 跌停 大跌 暴跌 重挫 下滑 走低 跳水 破位 创新低 新低 历史新低 弱势 疲软 低迷 亏损 损失 下降 减少 萎缩 业绩 低于预期 惨淡 糟糕 恶化 困难 挑战 "
    "压力 危机 风险 卖出 减持 回避 看空 悲观 消极 利空 威胁 抛售 套现 撤资 退出 谨慎 担忧 忧虑 冷清 萧条 衰退 下行 动荡 不稳 震荡 调整 回调 修正 波动 不确定"
).split()
NEUTRAL = "平稳 稳定 持平 维持 保持 观望 等待 关注 分析 研究 评估 考虑 讨论 会议 公告 发布".split()
DEGREES = {
    "非常": 2.0, "极其": 2.0, "十分": 1.8, "相当": 1.6, "很": 1.5, "比较": 1.2, "较": 1.2, "稍": 0.8, "略": 0.8, "有点": 0.8,
    "不太": -0.5, "不": -1.0, "没有": -1.0, "未": -1.0,
}
NEGATIONS = "不 没 无 非 未 否 别 勿".split()
FINANCIAL = {
    "涨停": 3.0, "暴涨": 2.5, "大涨": 2.0, "强势": 1.8, "超预期": 2.0, "利好": 1.5, "买入": 1.8, "推荐": 1.5,
    "跌停": -3.0, "暴跌": -2.5, "大跌": -2.0, "弱势": -1.8, "低于预期": -2.0, "利空": -1.5, "卖出": -1.8, "回避": -1.5,
    "风险": -1.2, "危机": -2.0, "警告": -1.5, "担忧": -1.0, "不确定": -1.0, "波动": -0.8, "调整": -0.5,
}
NUMBER_PATTERNS = [
    (r"涨(?:幅|了)?\s*(\d+(?:\.\d+)?)%", 1.0),
    (r"跌(?:幅|了)?\s*(\d+(?:\.\d+)?)%", -1.0),
    (r"增长\s*(\d+(?:\.\d+)?)%", 0.8),
    (r"下降\s*(\d+(?:\.\d+)?)%", -0.8),
]
# Strong signals, first hit decides.
STRONG_SIGNALS = [("涨停", 1), ("跌停", -1), ("暴涨", 1), ("暴跌", -1), ("重大利好", 1), ("重大利空", -1)]
# Emotion words.
EMOTIONS = {
    "joy": "高兴 兴奋 喜悦 开心 乐观 积极".split(),
    "anger": "愤怒 生气 不满 抗议 谴责".split(),
    "fear": "恐惧 担心 忧虑 害怕 紧张 风险".split(),
    "sadness": "悲伤 失望 沮丧 难过 遗憾".split(),
    "surprise": "惊讶 意外 震惊 突然 没想到".split(),
    "trust": "信任 相信 可靠 稳定 安全".split(),
    "anticipation": "期待 期望 希望 预期 看好".split(),
    "disgust": "厌恶 反感 讨厌 恶心".split(),
}
