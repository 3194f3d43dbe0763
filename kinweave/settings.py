"""Default settings. Each block of literals below is a fixed value of the domain; results depend on it exactly."""

# Legal-form suffixes of organisations.
ORG_SUFFIXES = [
    "股份有限公司", "股份公司", "有限责任公司", "有限公司", "股份合作公司",
    "合伙企业", "集团", "总公司", "分公司", "公司",
]

# Fund managers, in lookup order.
FUND_MANAGERS = [
    "华夏", "南方", "易方达", "嘉实", "富国", "华泰柏瑞", "工银瑞信", "招商", "博时", "汇添富", "广发",
    "景顺长城", "兴全", "银华", "鹏华", "中欧", "交银", "国泰", "华安", "大成", "长信", "诺安", "融通",
    "万家", "前海开源", "国泰基金",
]

# Holders that only hold for others.
CHANNEL_NAMES = [
    "香港中央结算有限公司", "中国证券金融股份有限公司", "中央汇金资产管理有限责任公司", "HKSCC NOMINEES LIMITED",
]
CHANNEL_PATTERNS = [
    r".*交易型开放式指数.*",
    r".*指数.*证券投资基金.*",
    r".*证券投资基金.*",
    r".*社保.*",
    r".*社会保障.*",
    r".*资产管理计划$",
    r".*信托计划$",
    r".*客户资金.*",
    r".*客户信用.*|.*信用交易.*|.*信用账户.*",
    r".*保险.*产品.*",
    r"BARCLAYS|UBS|MORGAN|J\.?P\.?Morgan|DEUTSCHE BANK|BNP PARIBAS|CREDIT SUISSE|NORTHERN TRUST|STATE STREET"
    r"|CITIGROUP|GOLDMAN|高盛.*|MSCI|VANGUARD|BLACKROCK|MERRILL LYNCH|HSBC|DBS|NOMINEES",
    r".*自有资金$",
    r".*香港中央结算.*",
    r".*国有资产监督管理委员会.*",
    r".*国有资产监督管理局.*",
    r".*国有资产管理委员会.*",
    r".*国有资产管理监督.*",
    r".*财政局.*",
    r".*财政厅.*",
    r".*人民政府.*",
    r".*管理委员会$",
    r".*证监会.*",
    r".*监管局.*",
    r".*工业和信息化.*",
    r".*商务.*厅.*",
    r".*科学技术.*厅.*",
    r"^国务院$",
    r".*国务院.*委员会.*",
]

# Words that mark a kind of holder, title or controller.
PERSON_TYPE_WORDS = ["自然", "境内自然", "境外自然"]
FUND_TYPE_WORDS = ["基金", "私募"]
ORG_TYPE_WORDS = ["机构", "法人", "企业", "外资"]
HOLDER_ORG_WORDS = ["公司", "基金", "银行", "证券", "保险", "集团", "信托"]
CONTROLLER_ORG_WORDS = ["公司", "集团", "银行", "证券", "保险", "信托", "基金", "国资委", "委员会", "管理局"]
SENIOR_WORDS = [
    "总经理", "副总经理", "总裁", "副总裁", "财务", "董秘", "董事会秘书", "高级管理", "总监", "首席", "总经济师", "总工程师",
]
PLACEHOLDER_CONTROLLERS = ["无", "无实际控制人", "不详", "未知", "不适用", "—", "-", "无实际控制", "无实控人", "空"]

# Names of the feeds a holding can come from.
BATCH_SOURCE = "stock_gdfx_free_holding_detail_em"
CHANGE_SOURCE = "stock_ggcg_em"
POSITION_SOURCE = "stock_inner_trade_xq"
CONTROLLER_SOURCE = "stock_hold_control_cninfo"
COMPANY_SOURCE = "stock_info_a_code_name"

# Thresholds (percent), confidences and scores (hundredths) of the seven rules.
RULES = {
    "R1": {"enabled": True, "control": 50.0, "significant": 20.0, "related_party": 5.0, "top_rank": 10,
           "control_score": 95, "significant_score": 85, "related_party_score": 75, "top_rank_score": 50},
    "R2": {"enabled": True, "score": 90},
    "R3": {"enabled": True, "min_ratio": 5.0, "same_period": True, "score": 30},
    "R4": {"enabled": True, "title_classes": ["director", "supervisor", "senior_mgmt"], "score": 70},
    "R5": {"enabled": True, "min_ratio": 5.0, "title_classes": ["director", "supervisor", "senior_mgmt"], "score": 80},
    "R6": {"enabled": True, "max_hops": 3, "min_effective_ratio": 5.0, "score": 75},
    "R7": {"enabled": True, "score": 70},
}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
REPEAT_BONUS = 10
REVIEW_RULE_ORDER = ["R2", "R1", "R4", "R5", "R3", "R6", "R7"]

# Homonym signals, in thousandths, with their weights in percent.
SIGNAL_WEIGHTS = {"name_rarity": 25, "holding_cross": 25, "company_count": 20, "region_match": 5, "tenure_overlap": 25}
SAME_ABOVE = 700
DIFFERENT_BELOW = 400

# Which side of the group a disclosed relation points to.
UPSTREAM_DESC = [
    "控股股东", "母公司", "实际控制人", "实控人", "最终控制", "持有5%", "5%以上", "第一大股东", "董事", "监事", "高级管理",
    "高管", "同一控制", "同受.*控制", "受.*控制", "兄弟", "担保方", "被担保方", "股东之子公司", "股东单位", "董事长", "总经理",
    "控制方", "关键管理", "近亲属", "主要投资者",
]
DOWNSTREAM_DESC = [
    "子公司", "控股子公司", "全资子公司", "全资孙公司", "孙公司", "联营企业", "联营", "合营企业", "合营", "参股公司",
    "参股企业", "参股", "分公司", "子企业", "少数股东", "子公司之",
]
DOWNSTREAM_NAME = ["子公司", "孙公司", "联营", "合营", "参股", "分公司"]
SCOPE_ORG_WORDS = ["公司", "集团", "企业", "基金", "银行", "证券"]

# Place names dropped for an alias, and words too general to be one.
PLACE_PREFIXES = [
    "贵州", "深圳", "宁波", "北京", "上海", "广东", "福建", "四川", "重庆", "山东", "江苏", "浙江", "安徽", "湖北", "湖南",
    "河南", "河北", "山西", "陕西", "江西", "辽宁", "吉林", "黑龙江", "云南", "广西", "甘肃", "海南", "西藏", "青海", "新疆",
    "内蒙古", "宁夏", "天津", "南京", "杭州", "成都", "广州", "武汉", "长沙", "郑州", "苏州", "无锡", "厦门", "青岛", "大连",
    "沈阳", "长春", "哈尔滨", "昆明", "兰州", "合肥", "福州", "南昌", "太原",
]
GENERIC_ALIASES = [
    "银行", "能源", "证券", "地产", "科技", "集团", "控股", "发展", "实业", "建工", "建科", "旅游", "机场", "热电", "燃气",
    "矿业", "路桥", "钢铁", "铜业", "高新", "高科", "高速", "黄金", "啤酒", "医药", "凤凰", "新能", "投资", "置业", "股份",
]

# Words of a question that give away what is asked.
INTENT_WORDS = {
    "Q8": ["对比", "比较", "比较一下", "对比一下", "区别", "差异"],
    "Q6": ["关联方重合", "关联方交集", "共同关联方", "关联方重叠"],
    "Q2": ["什么关系", "关系", "有关联", "关联吗"],
    "Q3": ["控制哪些", "持有哪些", "持股", "在哪些公司", "任职", "担任", "控制"],
    "Q5": ["担保", "诉讼", "质押", "风险事件", "风险", "法律纠纷"],
    "Q4": ["前十大股东", "十大股东", "股东", "高管", "董监高", "董事", "监事", "总经理", "实控人", "实际控制人", "基本信息"],
    "Q1": ["关联方", "关联关系", "关联交易", "关联人"],
}
INTENT_PATTERNS = {
    "Q6": [".*和.*关联方重合.*", ".*和.*共同关联方.*", ".*和.*关联方交集.*", ".*和.*关联方重叠.*"],
    "Q3": [".*控制.*公司.*", ".*持有.*上市.*", ".*持股.*公司.*", ".*在.*公司.*任职.*", ".*担任.*"],
    "Q5": [".*的担保.*", ".*的诉讼.*", ".*的质押.*", ".*风险事件.*"],
    "Q4": [".*的股东.*", ".*的实控人.*", ".*的董监高.*", ".*实际控制人.*"],
    "Q1": [".*的关联方.*", ".*关联方有.*", ".*关联方清单.*"],
}
TWO_CODES = r"(\d{6})\s*(?:和|与|跟|及)\s*(\d{6})"
TWO_NAMES = (r"([\u4e00-\u9fa5A-Za-z]{2,15})\s*(?:和|与|跟|及)\s*([\u4e00-\u9fa5A-Za-z]{2,15})"
             r".*(?:关系|关联|重合|交集|重叠)")
SIMPLE_FACT = "前十大股东|十大股东|股东|高管|董监高|董事|监事|总经理|实控人|实际控制人|基本信息|注册|行业|市值"
SIMPLE_RELATION = "关联方|关联关系|关联交易"
SIMPLE_RELATIONSHIP = "什么关系|关系|关联"

# Words that fill a slot.
EVENT_WORDS = {"担保": "guarantee", "诉讼": "lawsuit", "质押": "pledge", "法律纠纷": "lawsuit"}
EVENT_LABELS = {"guarantee": "担保", "lawsuit": "诉讼", "pledge": "质押", "related_txn": "关联交易"}
ROLE_WORDS = {
    "前十大股东": "holder", "十大股东": "holder", "股东": "holder", "实际控制人": "controller", "实控人": "controller",
    "董监高": "all", "高管": "all", "董事": "director", "监事": "director", "总经理": "director",
}

# Words that point back to an earlier turn.
PRONOUNS = ["它", "它的", "该公司", "该股", "这家", "这家公司", "这个", "这只", "该", "其"]
ORDINALS = {
    "第一": 0, "第二个": 1, "第二": 1, "第三个": 2, "第三": 2, "第四个": 3, "第四": 3, "第五个": 4, "第五": 4,
    "最后那个": -1, "最后一个": -1, "最后": -1, "前面那个": 0, "前面那个公司": 0,
}
OMISSION_WORDS = ["关联方", "担保", "诉讼", "质押", "股东", "实控人", "董监高", "风险事件"]
FOCUS_TURNS = 3
SESSION_GAP_SECONDS = 1800

# How a statement is read.
MENTION_SUFFIXES = [
    "股份有限公司", "股份公司", "有限责任公司", "有限公司", "合伙企业", "集团", "控股", "科技", "投资", "实业", "发展",
    "银行", "证券", "保险", "医药", "能源", "矿业",
]
MENTION_STOP_WORDS = [
    "的", "是", "包括", "含有", "和", "与", "跟", "及", "为", "在", "了", "有", "由", "从", "对", "向", "被", "将", "把", "给", "到", "这", "那", "该", "本", "其", "某", "一",
]
MENTION_BREAK = r"，,。；;：:、\s（）()\"'“”‘’\*\-_#\[\]`"
MENTION_GENERIC = [
    "该公司", "双方", "两家公司", "其中", "上述", "该股", "这只", "本系统", "系统", "数据", "结果", "查询", "以上", "如下",
    "有限公司", "股份有限公司", "集团", "控股", "科技", "投资", "实业", "发展", "银行", "证券", "保险", "知名投资",
    "知名投资控股", "知名", "重要", "主要", "核心",
]
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)\s*%"
AMOUNT_PATTERN = r"(\d[\d,.]*)\s*(万亿元|万元|亿元|元|万亿|万|亿)"
DATE_PATTERN = r"(\d{4})[-/年](\d{1,2})[-/月]?(\d{0,2})日?"
COUNT_PATTERN = r"(\d+)\s*(?:家|条|个|项|笔|起)"
WORDING_CLASSES = [
    ("评价性表述", r"更稳健|更健康|风险更高|风险更大|风险较低|优于|劣于|更优|更差|更好|更安全|值得.*关注|建议.*关注"),
    ("投资倾向", r"看好|看空|推荐|买入|卖出|增持|减持|超配|低配"),
    ("因果推断", r"因为.*所以|导致|表明|说明|意味着|由此可知|可以看出|这说明"),
]
SECTION_HEADERS = ["关联方及关联交易", "关联方情况", "关联方披露", "关联方关系"]
SECTION_BOUNDARY = r"^(第[一二三四五六七八九十百]+节|[一二三四五六七八九十百]+、|\([一二三四五六七八九十百]+\))"
ORG_IN_TEXT = (r"([^\s，。、；：“”‘’()（）\[\]【】]{2,30}"
               r"(?:有限公司|股份有限公司|有限责任公司|集团|企业|事务所|中心|合伙企业|研究院|厂|学校|医院|协会|基金会))")
TABLE_STOP_ROWS = [
    "无", "/", "—", "合计", "小计", "应收账款", "合同资产", "预付款项", "其他应收款", "长期应收款", "其他非流动资产",
    "应付账款", "预收款项", "其他应付款", "长期应付款", "存货", "固定资产", "无形资产", "在建工程", "货币资金",
    "交易性金融资产", "营业收入", "营业成本", "管理费用", "销售费用", "财务费用", "净利润", "资产总计", "负债合计",
    "所有者权益合计", "项目", "科目", "类别", "合营企业", "联营企业", "子公司", "联营公司", "合营公司", "分公司", "本公司",
    "控股子公司", "全资子公司", "控股公司", "关联方", "母公司", "同一控制下", "同一母公司", "其他关联方", "主要投资者个人",
    "关键管理人员", "合营", "联营",
]
EXTRACTED_EVENT_TYPES = ["related_txn", "investment", "penalty", "guarantee", "lawsuit", "other"]

# What a logged SQL text may use.
SQL_TABLES = ["company", "entity", "holding", "position", "actual_controller", "event"]
SQL_COLUMNS = [
    "stock_code", "short_name", "full_name", "industry", "list_date", "market_cap", "is_st", "entity_id", "display_name",
    "canonical_name", "entity_type", "is_channel", "confidence", "id", "ratio", "report_period", "source", "holder_rank",
    "title", "title_class", "control_ratio", "valid_from", "subject_code", "event_type", "event_date", "counterparty",
    "amount", "summary", "source_type",
]
SQL_FORBIDDEN = r"\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|REPLACE|ATTACH|DETACH|PRAGMA|VACUUM|REINDEX)\b"
SQL_MAX_LIMIT = 200

# Closing notes of a dossier unless the caller gives others.
DOSSIER_NOTES = {
    "data_sources": "见各条目的来源字段",
    "report_period": "见各条目的报告期",
    "coverage": "以所给表为限",
    "known_limits": "来源缺失的比例与日期按未知处理",
    "disclaimer": "候选与证据仅供核查参考",
}

# What is hidden in logged text, and by what.
REDACTIONS = [
    (r"sk-[a-zA-Z0-9]{10,}", "sk-***"),
    (r"Bearer\s+[a-zA-Z0-9]{10,}", "Bearer ***"),
    (r"(?i)api[_-]?key[=:]\s*\S+", "api_key=***"),
]
