"""Chinese hotline rule pack: words and patterns of the complaint domain.

All tables here are fixed values that results depend on, in order of priority
where order matters. Patterns are Java regular expressions.
"""

from __future__ import annotations

# fixed values: boilerplate phrases that carry no meaning
BOILERPLATE = [
    "市民致电反映", "市民反映", "诉求人表示", "诉求人反映", "据市民反映", "据诉求人反映", "希望相关部门介入", "希望部门介入",
    "要求部门处理", "要求相关部门处理", "要求给予合理解释", "要求部门给与合理解释", "请相关部门核实", "请部门核实", "市民希望",
    "诉求人希望", "市民要求", "诉求人要求", "市民表示", "（市民方便接听部门电话）", "（市民不方便接听部门电话）", "（工单号：",
    "跟进中。", "跟进中", "已跟进", "市民来电反映", "来电反映",
]

# fixed values: towns with their kind, and the communities of each
TOWNS = ["大良街道", "容桂街道", "伦教街道", "勒流街道", "陈村镇", "北滘镇", "乐从镇", "龙江镇", "杏坛镇", "均安镇"]
DISTRICT = "顺德区"

# fixed values: titles after a name, and the three that are made one
PERSON_TITLES = ["先生", "女士", "小姐", "太太", "夫人", "老师", "师傅", "老板"]
CALLER_TITLES = {"小姐": "女士", "太太": "女士", "夫人": "女士"}

# fixed values: what an organisation's name must not begin with or hold
NAME_MUST_NOT_BEGIN = [
    "依法", "请部门", "希望部门", "要求部门", "相关部门", "请相关", "市民希望", "诉求人希望", "市民要求", "诉求人要求", "位于", "名称",
    "别墅", "车辆", "牌照", "近期", "期多次", "期", "近", "多次", "有人", "夜晚", "委会", "人民政", "存在", "因为", "导致", "影响",
    "市民", "诉求", "请部", "希望", "要求",
]
NAME_MUST_NOT_HOLD = [
    "希望", "要求", "请部", "介入", "处理", "核实", "调查", "处罚", "制止", "解决", "反映", "表示", "致电", "来电", "存在", "位于",
    "因为", "导致", "影响", "扰民", "违法", "燃放", "喧哗", "噪音", "市民", "诉求人", "尽快", "及时", "切实", "加强", "依法", "针对",
    "回复", "尊敬", "多次", "有人", "夜晚", "加油站", "放烟花", "担", "引发", "人为", "灾难", "附近", "楼盘", "住宅",
]
SUBJECT_BLACKLIST = [
    "没有向社区", "没有向村", "日通过企业", "未向社区", "非公开办", "日到店", "进入欧雅典广场", "点时工商局", "可提供委",
    "在商家的门店", "未有向所在村", "日入院到同江医院", "日在盈信广场",
]

# fixed values: kinds of organisation in order of priority: label, longest name before the suffix, suffixes
ORGANISATIONS = [
    ("小区", 12, "小区|花园|公寓|苑|居|府|村|社区|工业园|大厦|大楼|家园|雅苑|名居|公馆|庭院|新城|楼盘"),
    ("医院", 15, "医院|卫生院|卫生服务中心|诊所|门诊"),
    ("学校", 15, "学校|小学|中学|大学|幼儿园|学院"),
    ("物业", 15, "物业|管理处"),
    ("部门", 10, "局|委|办|大队|支队|分局|所|站|街道|镇"),
    ("企业", 20, "公司|厂|企业|集团|商店|商行|经营部"),
    ("商铺", 10, "体验馆|体育馆|博物馆|店|铺|餐厅|食店|超市|百货|烧烤店|商场"),
    ("场所", 10, "美食城|夜市街|商业街|广场|公园|市场|步行街|夜市|大道|路口|工地|街道"),
    ("民宿", 15, "民宿|客栈|旅馆|酒店|宾馆|公寓酒店"),
]
# fixed values: the same for the older extraction, which has four kinds
SUBJECTS = [
    (12, "小区|花园|公寓|苑|居|府|村|社区|工业园|大厦|大楼|家园|雅苑|名居|公馆|庭院|新城|楼盘"),
    (15, "医院|卫生院|卫生服务中心|诊所|门诊|学校|小学|中学|大学|幼儿园|学院|物业|管理处|局|委|办|大队|支队|分局|所|站"),
    (20, "公司|厂|企业|集团|商店|商行|经营部"),
    (12, "体验馆|体育馆|博物馆|店|铺|餐厅|食店|超市|百货|烧烤店|商场|美食城|夜市街|商业街|广场|公园|市场|步行街|夜市|大道|路口|工地|街道|镇"),
]

# fixed values: texts about wages, where a company is looked for first
LABOUR_WORDS = ["拖欠", "欠薪", "克扣", "工资", "薪酬", "劳务", "工作", "工钱", "不发"]
LABOUR_NAME_MUST_NOT_HOLD = [
    "拖欠", "欠薪", "克扣", "工资", "薪酬", "单位", "反映", "来电", "致电", "表示", "全厂", "全店", "存在", "正在", "以及", "公司地址",
    "项目", "要求", "希望", "请部", "介入",
]
COMPANY = "有限公司|公司|厂|集团|分公司|劳务|服务部|经营部"
GENERIC_SUFFIX = ["街道", "镇", "社区", "村", "居委会", "村委会"]

# fixed values: patterns of a company in texts about wages, and of a person's name
LABOUR_COMPANIES = [
    r"(?:名称|名字|单位名称)[:：]\s*([一-龥A-Za-z0-9]{2,25})",
    r"项目单位[:：]\s*([一-龥A-Za-z0-9]{2,20})",
    rf"在([一-龥A-Za-z0-9]{{2,25}}?(?:{COMPANY}|物流园))工作",
    rf"(?:被|反映被)(?:佛山市顺德区|佛山市|顺德区)?([一-龥A-Za-z0-9]{{2,25}}?(?:{COMPANY}))(?=[\s，,。？（(]|拖欠)",
    rf"([一-龥A-Za-z0-9]{{2,20}}(?:分拨中心|物流园|工业园|{COMPANY}))[（(]?地址",
    rf"([一-龥A-Za-z0-9]{{2,20}}(?:{COMPANY}))\s*(?:，|,)?\s*拖欠",
    rf"([一-龥A-Za-z0-9]{{2,20}}(?:{COMPANY}))[的]?(?:员工|人员|工人|职工)",
]
PERSONS = [
    rf"(?<![市民诉求])([一-龥])({'|'.join(PERSON_TITLES)})",
    r"([一-龥])某(?:某)?",
    r"市民([一-龥])(?:先生|女士|小姐)",
    r"诉求人([一-龥])(?:先生|女士|小姐)",
]

# fixed values: address parts
ESTATE_SUFFIXES = ["小区", "花园", "华府", "豪庭", "家园", "雅苑", "名居", "公馆", "广场", "新城", "庭院", "楼盘", "公寓", "社区", "苑", "村", "府", "庭", "居"]
ADDRESS_LEAD = [
    "市民", "诉求人", "反映", "致电", "来电", "表示", "希望", "要求", "请部", "介入", "处理", "核实", "存在", "位于", "因为", "导致",
    "影响", "扰民", "噪音", "违法", "燃放", "喧哗", "尽快", "及时", "切实", "加强", "依法", "针对", "回复", "尊敬", "是", "其", "该",
    "此", "于", "在", "的", "了", "自己", "自家", "顺德区", "佛山市", "广东省", "人民政府", "居委会", "委会", "新城", "新村",
]
ADDRESS_MUST_NOT_HOLD = [
    "市民", "诉求", "反映", "致电", "来电", "表示", "人民政", "委会", "位于", "存在", "感谢", "您好", "尊敬", "针对", "回复", "执法",
    "处理", "核实", "调查", "202", "201", "200", "199",
]

# fixed values: recurring times
TIME_WORDS = [
    ("每晚", "nightly"), ("每天晚上", "nightly"), ("每天", "daily"), ("每周", "weekly"), ("工作日", "workday"), ("周末", "weekend"),
    ("凌晨", "early_morning"), ("夜间", "nightly"), ("半夜", "nightly"),
]

# fixed values: channel and nature of a ticket
ONLINE_WORDS = ["网店", "网购", "淘宝", "京东", "拼多多", "抖音", "快手", "平台", "APP", "小程序", "网站", "网络", "线上", "退款", "退货", "售后", "客服", "订单", "虚假宣传", "虚假广告", "刷单", "好评"]
OFFLINE_WORDS = ["现场", "实地", "门店", "实体店", "线下", "施工", "工地", "违建", "占道", "摆摊", "噪音", "扰民", "油烟", "粉尘", "异味", "垃圾", "污水", "堵塞", "破损", "塌陷", "路灯", "井盖", "护栏", "绿化"]
NATURES = [
    ("complaint", ["投诉", "反映问题", "存在问题", "严重影响", "扰民", "不满", "强烈要求", "多次反映", "至今未解决", "违规", "违法", "损坏", "污染", "噪音", "臭味"]),
    ("suggestion", ["建议", "希望改进", "建议增加", "建议优化", "可以考虑", "是否可以考虑", "建议相关部门", "建议加强"]),
    ("report", ["举报", "揭发", "举报违法", "举报违规", "举报非法", "无证经营", "非法", "黑车", "黑作坊", "黑诊所", "偷排", "偷排污水", "偷倒垃圾"]),
    ("consultation", ["咨询", "请问", "想了解", "想咨询", "查询", "如何办理", "怎么办理", "办理流程", "需要什么材料", "政策解读", "政策咨询"]),
    ("help", ["求助", "帮助", "请求帮助", "急需帮助", "困难", "申请", "援助", "救济", "补贴", "救助"]),
]

# fixed values: event types in order of priority, each with its keywords
EVENT_TYPES = [
    ("噪音扰民", ["噪音", "扰民", "喧哗", "音响", "音乐声音", "施工噪音", "半夜", "噪声"]),
    ("拖欠工资", ["拖欠工资", "拖欠薪资", "欠薪", "拖欠工资问题", "拖欠", "克扣工资", "被克扣"]),
    ("劳动纠纷", ["劳动纠纷", "劳动合同", "解除劳动合同", "社保", "失业保险金", "劳动关系", "离职证明"]),
    ("消费纠纷", ["消费纠纷", "消费维权", "退款", "退费", "商品质量", "虚假宣传", "网购", "网购纠纷", "质量问题", "售后", "维修", "退货", "三包", "商家", "超市", "价格", "收费问题", "收费不合理"]),
    ("违法建设", ["违建", "违法建设", "违章建筑", "违法搭建", "违规搭建", "集装箱", "加建", "改建", "扩建"]),
    ("物业管理", ["物业服务", "物业公司", "物业管理", "物业问题", "物业履职", "物业费", "业委会", "业主委员会", "保安", "保洁", "停车场管理", "停车管理", "物业收费", "充电桩"]),
    ("房屋质量", ["房屋开裂", "墙体开裂", "墙面开裂", "漏水", "渗水", "塌陷", "下陷", "危房", "房屋质量", "装修"]),
    ("占道经营", ["占道经营", "乱摆卖", "流动摊贩", "占道摆卖", "占道经营问题"]),
    ("交通问题", ["交通", "违停", "乱停", "乱停乱放", "停车", "路阻", "堵车", "冲卡", "外来车辆", "车辆停放", "占道停放", "红绿灯", "逆行", "酒驾"]),
    ("环境卫生", ["垃圾", "卫生", "臭味", "污水", "乱扔", "四害", "灭四害", "下水", "化粪"]),
    ("市政设施", ["路灯", "井盖", "路面", "破损", "道路损坏", "道路施工", "人行道", "围蔽"]),
    ("燃放烟花", ["烟花", "爆竹", "燃放"]),
    ("环境污染", ["污染", "废气", "油烟", "粉尘", "养猪场", "嗅气", "异味", "扬尘"]),
    ("养殖问题", ["养殖", "禽畜", "鸡", "鸭", "狗叫"]),
    ("食品安全", ["食品含异物", "食品安全", "食材问题", "餐饮卫生", "餐馆", "餐厅", "食物中毒", "过期食品"]),
    ("证照办理", ["注册登记", "注册问题", "注册登", "注销登记", "设立登记", "企业变更", "地址变更", "营业执照", "个体户", "个体工商户", "经营许可", "食品经营许可", "特种设备", "证照", "居住证", "身份证", "结婚登记", "户籍", "入户"]),
    ("社保医保", ["社保", "医保", "参保", "报销", "养老金", "退休金", "退休", "补贴", "失业金", "失业保险", "工伤", "生育保险", "缴费", "减员", "伤残补助", "门诊", "门特", "异地就医", "参保缴费"]),
    ("教育问题", ["学校", "老师", "入学", "招生", "中考", "高考", "教育", "幼儿园", "学费", "补课"]),
    ("物流快递", ["物流", "快递", "货运", "托运", "配送"]),
    ("无证经营", ["无证", "无照", "黑车", "非法营运"]),
    ("咨询办理", ["咨询", "申请", "办理", "指引", "疑问", "如何", "流程", "资料补正"]),
]

# fixed values: what happened, by event type: (keywords, action) in order, then the action without any of them
EVENT_ACTIONS = {
    "噪音扰民": ([(["喧哗"], "客人喧哗"), (["音响", "音乐"], "音响播放"), (["施工"], "施工")], "产生噪音"),
    "拖欠工资": ([], "拖欠薪资"),
    "占道经营": ([(["摆卖", "摊贩"], "占道摆卖")], "占道经营"),
    "物业管理": ([(["保安", "保洁"], "保安保洁缺位"), (["停车"], "停车管理不力"), (["费"], "物业收费争议")], "物业服务不到位"),
    "交通问题": ([(["冲卡", "外来车辆"], "外来车辆冲卡进入"), (["违停", "乱停"], "车辆违停"), (["占道"], "车辆占道停放")], "车辆停放问题"),
    "燃放烟花": ([], "燃放烟花"),
    "环境卫生": ([(["垃圾"], "乱丢垃圾"), (["污水"], "污水排放"), (["四害"], "四害滋生")], "影响卫生"),
    "房屋质量": ([(["开裂"], "墙体开裂"), (["漏水", "渗水"], "房屋漏水"), (["塌陷", "下陷"], "地面塌陷")], "房屋质量问题"),
    "食品安全": ([(["异物"], "食品含异物"), (["餐饮", "餐厅", "餐馆"], "餐饮卫生问题")], "食品安全问题"),
    "证照办理": ([(["注册", "设立"], "企业/个体注册登记"), (["注销"], "注销登记"), (["变更"], "登记信息变更"), (["营业执照"], "营业执照办理")], "证照办理"),
    "社保医保": ([(["报销"], "医保/费用报销"), (["退休"], "退休待遇"), (["失业"], "失业金申领"), (["参保", "缴费"], "参保缴费"), (["工伤"], "工伤待遇")], "社保医保业务"),
    "教育问题": ([(["入学", "招生"], "入学招生"), (["收费", "学费"], "教育收费"), (["老师", "补课"], "教学管理")], "教育管理问题"),
    "物流快递": ([], "物流快递纠纷"),
    "咨询办理": ([], "咨询/申请办理"),
}

# fixed values: requests in order of priority, each with its keywords
REQUESTS = [
    ("制止噪音扰民", ["制止噪音", "停止噪音", "解决噪音", "消除噪音", "噪音扰民"]),
    ("制止占道经营", ["清理占道", "取缔占道", "制止占道", "整治摆卖"]),
    ("查处违法建设", ["查处违建", "拆除违建", "拆除违法", "整治违建", "违规搭建", "违法搭建"]),
    ("追讨工资", ["发放工资", "支付工资", "追回工资", "补发工资", "支付薪资", "克扣工资"]),
    ("退还费用", ["退款", "退费", "退还", "退货", "退钱"]),
    ("依法处罚", ["依法处罚", "处罚违法", "依法查处", "处罚"]),
    ("处理交通违停", ["处理违停", "处理乱停", "拖离", "乱停乱放"]),
    ("修复市政设施", ["修复路灯", "修复井盖", "修复路面", "维修", "道路破损", "人行道破损"]),
    ("整治环境卫生", ["清理垃圾", "处理污水", "整治卫生", "灭四害", "除四害"]),
    ("查处食品安全", ["食品含异物", "食品安全", "餐饮卫生", "食材问题"]),
    ("房屋质量整改", ["房屋开裂", "墙体开裂", "房屋漏水", "墙体渗水", "地面塌陷", "房屋质量"]),
    ("协调处理物业服务", ["物业服务问题", "物业问题", "物业履职", "物业管理问题", "协调处理此物业", "处理物业服务", "介入协调处理此物业"]),
    ("补办证照", ["办理营业执照", "注册登记", "注销登记", "设立登记", "证照办理", "补办身份证", "居住证办理", "结婚登记", "营业执照"]),
    ("社保医保报销", ["医保报销", "社保报销", "工伤报销", "门诊报销", "门特报销"]),
    ("投诉商家", ["投诉商家", "商家问题", "消费维权", "网购纠纷", "商品质量", "售后服务"]),
    ("咨询办理", ["咨询", "申请办理", "如何办理", "办理流程", "申请补贴", "疑问", "希望了解", "想了解", "请教"]),
    ("介入处理", ["介入处理", "介入", "处理", "跟进", "核实"]),
]
REQUEST_VERBS = ["制止", "查处", "追讨", "退还", "处理", "整治", "修复", "介入", "协调"]
REQUEST_FALLBACK = (["希望", "要求", "请", "建议"], "介入处理")

# fixed values: venues and landmarks
VENUE_SUFFIXES = [
    "商业街", "步行街", "美食城", "工业园", "工业区", "大排档", "烧烤店", "市场", "广场", "大厦", "大楼", "公园", "码头", "中心", "商场", "超市",
    "百货", "夜市", "车站", "酒店", "宾馆", "医院", "学校", "小学", "中学", "幼儿园", "餐厅", "饭店", "酒吧", "KTV", "ktv",
]
VENUE_BOUNDARY = "区社村号路街巷道门口的在场旁附近正现于（()），,、。;；"
LANDMARKS = [
    "小区", "花园", "公寓", "公馆", "家园", "雅苑", "名居", "庭院", "新城", "楼盘", "华庭", "市场", "广场", "大厦", "大楼", "写字楼",
    "中心", "工业区", "工业园", "公园", "路", "街", "大道", "巷", "号", "村", "社区", "苑", "府", "店", "铺", "酒店", "宾馆", "超市", "商场",
]

# fixed values: title tags' length and the words before an event in a title; events that are one whatever the subject
TITLE_ACTIONS = ["再次反映", "继续反映", "重复反映", "反映", "投诉", "举报", "咨询", "求助"]
SYSTEMIC_EVENTS = ["失业保险金"]

# fixed values: header aliases of the standard fields, searched in this order
FIELD_ALIASES = {
    "order_id": ["order_id", "工单编号", "工单号", "编号", "单号", "id", "工单id"],
    "content": ["content", "诉求内容", "工单内容", "内容", "诉求", "事件描述", "问题描述", "描述"],
    "title": ["title", "标题", "工单标题", "事件标题", "事项标题"],
    "subject": ["subject", "涉及主体", "主体", "涉事主体", "涉及对象", "对象", "被诉主体"],
    "area": ["area", "事发区域", "区域", "发生区域", "所属区域", "属地", "地点", "地址"],
    "submit_time": ["submit_time", "提交时间", "受理时间", "创建时间", "时间", "发生时间", "上报时间", "登记时间"],
}

# fixed values: places in which two addresses count as one, and subjects too general for that
PLACE_LANDMARKS = ["村", "社区", "路", "街", "大道", "园", "市场", "广场", "工业区"]
GENERIC_SUBJECTS = ["政府", "村委会", "居委会", "村委", "居委", "物业公司", "物业", "管理处", "服务中心"]
