"""Word lists of the name and company heuristics.

Fixed values: results depend on these lists, so they are stated as they are used. The surnames are a
parameter: SURNAMES is the whole list, and another one is a text file of one's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: Characters that surnames begin with or consist of: the Hundred Family Surnames, then compound ones.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚程嵇邢滑裴陆荣翁荀羊於惠甄曲家封芮羿储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭厉戎祖武符刘景詹束龙叶幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙池乔阴鬱胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍却璩桑桂濮牛寿通边扈燕冀郏浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东欧殳沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公"
    "欧阳太史端木上官司马东方独孤南宫万俟闻人夏侯诸葛尉迟公羊赫连澹台皇甫宗政濮阳公冶太叔申屠公孙慕容仲孙钟离长孙宇文司徒鲜于司空闾丘子车亓官司寇巫马公西颛孙壤驷公良漆雕乐正宰父谷梁拓跋夹谷轩辕令狐段干百里呼延东郭南门羊舌微生公仪梁丘左丘东门西门"
)

#: Labels before a name, in the order in which they are tried.
NAME_LABELS = (
    "姓名 联系人 负责人 法定代表人 法人代表 签字人 经办人 担保人 被保证人 合作方 借款人 申请人 委托人 受托人 保证人 "
    "抵押人 出质人 权利人 义务人 投保人 被保险人 受益人 收款人 付款人 开户人 持卡人 董事 监事 总经理 董事长"
).split()
#: Words that are no names.
NOT_NAMES = frozenset(
    "公司 机构 项目 包括 问题 情况 材料 文件 报告 内容 信息 数据 金额 合同 协议 条款 先生 女士 经理 董事长 总经理 负责人 甲方 乙方 "
    "联系人 代表 单位 产品 服务 客户 本人 他们 我们 你们 大家 东西 时候 地方 事情 国家 银行 学校 医院 人员 业务 经办人 担保人 被保证人 "
    "合作方 借款人 申请人 委托人 受托人 保证人 抵押人 出质人 权利人 义务人 投保人 被保险人 受益人 收款人 付款人 开户人 持卡人 签字人 "
    "管理人 托管人 代理人 经纪人 介绍人 中间人 中介人 联络人 法人 自然人 监护人 法定代表人 法人代表 董事会 监事会 总监 副总 董事 监事 "
    "股东 员工 用户 记者 医生 律师 老师 学生 人士 主管 专员 工程师 技术员 领导 同志 秘书 助理 财务 人事 行政 部门 账号 账户 卡号 手机 "
    "电话 邮箱 地址 日期 时间 经办 担保".split()
)
#: Characters that end a given name, and those that may stand beside a name.
NAME_STOPS = frozenset("与和及或等以及被把将让以向对从为是之的了着过我你他她它们这那其该")
NAME_BESIDE = frozenset("为是由系叫称的和与被把将让以向对从")

#: How company names end, for certain and perhaps.
LEGAL_ENDS = "股份有限公司 有限责任公司 集团有限公司 有限公司 集团公司 集团 控股 股份 公司".split()
TRADE_ENDS = "科技 银行 证券 基金 保险 制造 建设 能源 投资 地产 置业 事务所 研究院".split()
#: What may not follow the latter, and what may; the longest beginning before them.
TRADE_GLUE = frozenset("卡账号费业会局部所园网站馆心场区产品")
TRADE_AFTER = frozenset("与和及或等以及")
TRADE_HEAD = 6
#: Phrases that are no companies, and endings that make none.
NOT_COMPANIES = frozenset(
    "子公司 分公司 总公司 全资子公司 控股子公司 母公司 集团公司 上市公司 证券公司 基金管理公司 信托公司 租赁公司 咨询公司 保险公司 "
    "期货公司 网上银行 手机银行 电话银行 商业银行 人民银行 开发银行 投资基金 担保公司 融资公司".split()
)
NOT_COMPANY_ENDS = ("网上银行", "手机银行", "电话银行", "子公司", "上市公司")
NOT_COMPANY_STARTS = frozenset("本该某我你此这那其")
#: Where the way back from an ending stops, and how far it goes.
BOUNDARIES = frozenset(" \t\n\r，。；！？、：:\"“”‘’'（）()[]{}〈〉《》·-—…,;!?")
PARTICLES = frozenset("为是由与和及或在向对从被把的地得着了过等也都就才还很将会能但而却则若如除之以至")
ROLES = frozenset("甲方 乙方 丙方 丁方 我方 贵方 他方 对方 该公司 本公司 我公司 贵公司 某公司".split())
WAY_BACK, COMPANY_LENGTHS = 36, (2, 40)


@dataclass(frozen=True)
class Lexicon:
    surnames: frozenset[str] = field(default_factory=lambda: frozenset(SURNAMES))


def read_surnames(path: str | Path) -> frozenset[str]:
    """Every character of a file but white space."""
    return frozenset("".join(Path(path).read_text(encoding="utf-8").split()))
