"""Rule tables, word lists and formats that results depend on.  Rules are data; operators compile them to CASE chains."""

from __future__ import annotations

# Relation phrase, canonical id, whether the phrase states a yearly figure.
RELATION_EXACT = [
    ("实测径流量为", "ANNUAL_RUNOFF", True),
    ("当年实测径流量为", "ANNUAL_RUNOFF", True),
    ("2024年实测径流量为", "ANNUAL_RUNOFF", True),
    ("上年实测径流量为", "ANNUAL_RUNOFF", True),
    ("当年天然河川径流量为", "ANNUAL_RUNOFF", True),
    ("天然河川径流量为", "ANNUAL_RUNOFF", True),
    ("当年7~10月实测径流量为", "ANNUAL_RUNOFF_FLOOD_SEASON", True),
    ("1987~2016年实测径流量均值为", "LONG_TERM_AVG_RUNOFF", False),
    ("1956~2016年实测径流量均值为", "LONG_TERM_AVG_RUNOFF", False),
    ("实测输沙量为", "ANNUAL_SEDIMENT", True),
    ("当年实测输沙量为", "ANNUAL_SEDIMENT", True),
    ("2024年实测年输沙量为", "ANNUAL_SEDIMENT", True),
    ("合计实测年输沙量为", "ANNUAL_SEDIMENT", True),
    ("上年降水量为", "ANNUAL_PRECIPITATION", True),
    ("当年降水量（毫米）为", "ANNUAL_PRECIPITATION", True),
    ("当年降水量（亿立方米）为", "ANNUAL_PRECIPITATION", True),
    ("2024年降水量（亿立方米）为", "ANNUAL_PRECIPITATION", True),
    ("2024年降水量为", "ANNUAL_PRECIPITATION", True),
    ("1987~2016年平均降水量为", "LONG_TERM_AVG_PRECIPITATION", False),
    ("1956~2016年平均降水量为", "LONG_TERM_AVG_PRECIPITATION", False),
    ("供水量流域内为", "WATER_SUPPLY", True),
    ("供水量调出流域为", "WATER_SUPPLY", True),
    ("供水量合计为", "WATER_SUPPLY", True),
    ("黄河地表水供水量为", "WATER_SUPPLY", True),
    ("地表水源流域内供水量为", "WATER_SUPPLY", True),
    ("地表水源调出流域供水量为", "WATER_SUPPLY", True),
    ("地表水源合计供水量为", "WATER_SUPPLY", True),
    ("地下水源供水量为", "WATER_SUPPLY", True),
    ("非常规水源供水量为", "WATER_SUPPLY", True),
    ("合计供水量为", "WATER_SUPPLY", True),
    ("总计供水量为", "WATER_SUPPLY", True),
    ("调入流水量为", "WATER_SUPPLY", True),
    ("2024年供水量为", "WATER_SUPPLY", True),
    ("用水量合计总量为", "WATER_USE", True),
    ("用水量农业总量为", "WATER_USE", True),
    ("2024年用水总量为", "WATER_USE", True),
    ("2024年地下水用水量为", "WATER_USE", True),
    ("耗水量流域内为", "WATER_CONSUMPTION", True),
    ("耗水量调出流域为", "WATER_CONSUMPTION", True),
    ("耗水量合计为", "WATER_CONSUMPTION", True),
    ("耗水量合计总量为", "WATER_CONSUMPTION", True),
    ("黄河地表水耗水量为", "WATER_CONSUMPTION", True),
    ("2024年耗水总量为", "WATER_CONSUMPTION", True),
    ("2024年地下水耗水量为", "WATER_CONSUMPTION", True),
    ("年初蓄水量为", "RESERVOIR_STORAGE_START", True),
    ("年末蓄水量为", "RESERVOIR_STORAGE_END", True),
    ("年蓄水变量为", "RESERVOIR_STORAGE_CHANGE", True),
    ("2024年年初蓄水量为", "RESERVOIR_STORAGE_START", True),
    ("2024年年末蓄水量为", "RESERVOIR_STORAGE_END", True),
    ("2024年年蓄水变量为", "RESERVOIR_STORAGE_CHANGE", True),
    ("2023年年末蓄水量为", "RESERVOIR_STORAGE_END", True),
    ("合计蓄水变量为", "RESERVOIR_STORAGE_CHANGE", True),
    ("合计水库年蓄水变量为", "RESERVOIR_STORAGE_CHANGE", True),
    ("平均地下水埋深年初", "GROUNDWATER_DEPTH_START", True),
    ("平均地下水埋深年末", "GROUNDWATER_DEPTH_END", True),
    ("平均地下水埋深年变幅", "GROUNDWATER_DEPTH_CHANGE", True),
    ("年初平均地下水埋深为", "GROUNDWATER_DEPTH_START", True),
    ("年末平均地下水埋深为", "GROUNDWATER_DEPTH_END", True),
    ("年变幅为", "GROUNDWATER_DEPTH_CHANGE", True),
    ("平均地下水埋深年变幅为", "GROUNDWATER_DEPTH_CHANGE", True),
    ("干流全长为", "RIVER_LENGTH", False),
    ("流域总面积为", "BASIN_AREA", False),
    ("控制面积为", "BASIN_AREA", False),
    ("计算面积为", "BASIN_AREA", False),
    ("面积为", "HAS_AREA", False),
    ("2024年面积为", "HAS_AREA", False),
    ("范围为", "HAS_SCOPE", False),
    ("供水区范围为", "HAS_SCOPE", False),
    ("所属行政区为", "BELONGS_TO_PROVINCE", False),
    ("所属水资源二级区为", "LOCATED_IN_ZONE", False),
    ("所属平原子", "LOCATED_IN_PLAIN", False),
    ("主要水文站包括", "HAS_STATION", False),
    ("重要支流控制水文站包括", "HAS_STATION", False),
    ("包括", "INCLUDES", False),
    ("属于", "BELONGS_TO", False),
    ("包含超采区序号", "HAS_OVERDRAFT_ZONE", False),
    ("地下水类型为", "GROUNDWATER_TYPE", False),
    ("与上年比较为", "COMPARE_LAST_YEAR", True),
    ("与上年比较变化为", "COMPARE_LAST_YEAR", True),
    ("与1987~2016年均值比较为", "COMPARE_LONG_TERM_AVG", False),
    ("与1956~2016年均值比较为", "COMPARE_LONG_TERM_AVG", False),
    ("水资源总量为", "WATER_RESOURCE_TOTAL", True),
    ("2024年水资源总量为", "WATER_RESOURCE_TOTAL", True),
    ("2024年入海水量为", "ANNUAL_RUNOFF_TO_SEA", True),
    ("平原区浅层地下水水位上升面积为", "GW_LEVEL_RISE_AREA", True),
    ("浅层地下水水位下降面积为", "GW_LEVEL_DECLINE_AREA", True),
    ("深层承压水水位上升面积为", "GW_LEVEL_RISE_AREA", True),
    ("死水位为", "DEAD_STORAGE_LEVEL", False),
    ("防洪限制水位为", "FLOOD_CONTROL_LEVEL", False),
    ("正常蓄水位为", "NORMAL_STORAGE_LEVEL", False),
    ("总库容为", "TOTAL_CAPACITY", False),
    ("装机容量为", "POWER_GENERATION", False),
    ("控制流域面积为", "BASIN_AREA", False),
    ("坝址以上流域面积为", "BASIN_AREA", False),
    ("所在河流为", "LOCATED_ON", False),
    ("所在河段为", "LOCATED_ON", False),
    ("坝址位于", "LOCATED_ON", False),
    ("所在地区为", "BELONGS_TO", False),
    ("自2023年起更名为", "STATION_RENAMED_TO", False),
]

# Ordered keyword rules; the first rule with a keyword in the phrase wins, within a rule the first keyword.
RELATION_KEYWORDS = [
    (("径流量", "径流"), "ANNUAL_RUNOFF", True),
    (("输沙量", "输沙"), "ANNUAL_SEDIMENT", True),
    (("降水量", "降水"), "ANNUAL_PRECIPITATION", True),
    (("供水量", "供水"), "WATER_SUPPLY", True),
    (("用水量", "用水"), "WATER_USE", True),
    (("耗水量", "耗水"), "WATER_CONSUMPTION", True),
    (("死水位", "死库容"), "DEAD_STORAGE_LEVEL", False),
    (("防洪限制", "汛限", "防洪限制水位"), "FLOOD_CONTROL_LEVEL", False),
    (("正常蓄水", "正常蓄水位"), "NORMAL_STORAGE_LEVEL", False),
    (("蓄水位", "水位"), None, False),
    (("防洪库容",), "FLOOD_CONTROL_CAPACITY", False),
    (("库容", "总库容"), "TOTAL_CAPACITY", False),
    (("蓄水量", "蓄水变量"), "RESERVOIR_STORAGE", True),
    (("地下水埋深", "埋深"), "GROUNDWATER_DEPTH", True),
    (("流域面积", "控制面积", "集水面积"), "BASIN_AREA", False),
    (("面积",), "HAS_AREA", False),
    (("长度", "全长"), "RIVER_LENGTH", False),
    (("水质", "水质类别"), "WATER_QUALITY", False),
    (("发电", "出力", "装机"), "POWER_GENERATION", False),
    (("生态", "环境"), "ECOLOGICAL_FLOW", False),
    (("改为", "更名为", "改名"), "STATION_RENAMED_TO", False),
    (("属于", "所属", "所在地区"), "BELONGS_TO", False),
    (("岸所属行政区", "左岸", "右岸", "南岸", "北岸"), "BELONGS_TO", False),
    (("水文站包括", "水文站为"), "HAS_STATION", False),
    (("包括", "包含", "划分为"), "INCLUDES", False),
    (("比较", "对比", "变化", "增幅", "减少", "偏少", "增加了"), "COMPARISON", True),
]

# Words that mark a phrase without a rule as yearly.
YEARLY_WORDS = ["径流", "输沙", "降水", "供水", "用水", "耗水", "蓄水", "埋深", "比较", "变化"]

# Objects that say nothing.
INVALID_OBJECTS = ["", "/", "1", "一", "-", "—", "无", "null", "None", "无数据"]

# Name parts that mark an object as an entity.
ENTITY_WORDS = ["水库", "水文站", "省", "自治区", "市", "县", "河", "流域", "区"]

PROVINCES = ["青海", "四川", "甘肃", "宁夏", "内蒙古", "山西", "陕西", "河南", "山东", "河北"]

# Ordered typing rules for subjects; (kind, words, type).  "sum" is a '+' together with one of the words.
SUBJECT_TYPES = [
    ("equals", ("合计", "总计"), "StatisticAggregate"),
    ("sum", ("合计", "总计"), "StatisticAggregate"),
    ("contains", ("超采区",), "GroundwaterOverdraftArea"),
    ("contains", ("盆地", "平原", "台地", "河谷", "风沙滩", "谷地", "景泰川", "董志塬"), "GroundwaterRegion"),
    ("contains", ("水库", "水电站", "水利枢纽"), "Reservoir"),
    ("contains", ("水文站",), "HydrologicalStation"),
    ("suffix", ("站",), "HydrologicalStation"),
    ("contains", ("省", "自治区"), "Province"),
    ("equals", ("青海", "四川", "甘肃", "宁夏", "内蒙古", "山西", "陕西", "河南", "山东", "河北"), "Province"),
    ("contains", ("河", "江", "水系"), "River"),
    ("contains", ("以上", "以下", "至", "区间", "内流区"), "WaterResourceZone"),
    ("contains", ("流域",), "River"),
    ("contains", ("水利部", "黄河水利委员会", "公报", "方案", "规划", "规程"), "Document"),
]

# Ordered labelling rules for graph nodes; they differ from the typing rules above.
NODE_LABELS = [
    ("contains", ("水库", "水电站", "水利枢纽"), "Reservoir"),
    ("contains", ("水文站",), "HydrologicalStation"),
    ("contains", ("省", "自治区"), "Province"),
    ("equals", ("青海", "四川", "甘肃", "宁夏", "内蒙古", "山西", "陕西", "河南", "山东", "河北"), "Province"),
    ("contains", ("河", "江"), "River"),
    ("contains", ("以上", "以下"), "WaterResourceZone"),
    ("longer3", ("至",), "WaterResourceZone"),
    ("equals", ("内流区",), "WaterResourceZone"),
    ("contains", ("超采区",), "GroundwaterOverdraftArea"),
    ("contains", ("盆地", "平原", "台地", "河谷", "风沙滩", "谷地", "川", "塬"), "GroundwaterRegion"),
    ("equals", ("合计", "总计"), "StatisticAggregate"),
    ("sum", ("合计", "总计"), "StatisticAggregate"),
    ("contains", ("水利部", "黄河水利委员会", "公报", "方案", "规划", "规程"), "Document"),
    ("contains", ("流域",), "River"),
    ("suffix2", ("区",), "WaterResourceZone"),
]

# Label of an object whose name says nothing, by relation id.
LABEL_HINTS = {
    "BELONGS_TO_PROVINCE": "Province",
    "LOCATED_IN_ZONE": "WaterResourceZone",
    "LOCATED_IN_PLAIN": "GroundwaterRegion",
    "STATION_RENAMED_TO": "HydrologicalStation",
    "LOCATED_ON": "River",
    "IS_TRIBUTARY_OF": "River",
    "HAS_OVERDRAFT_ZONE": "GroundwaterOverdraftArea",
    "HAS_STATION": "HydrologicalStation",
    "SOURCE_FROM": "Document",
}

# Subject types that count as new entities when no alias is known.
NEW_ENTITY_TYPES = ["Unknown", "GroundwaterOverdraftArea", "StatisticAggregate"]

# Labels that statistics report.
STAT_LABELS = ["Reservoir", "HydrologicalStation", "WaterResourceZone", "Province", "River", "DispatchRule", "Constraint", "AnnualHydrologyData", "Document"]

# Relation ids of constraints by category.
CONSTRAINT_IDS = {
    "water_level": ["DEAD_STORAGE_LEVEL", "FLOOD_CONTROL_LEVEL", "NORMAL_STORAGE_LEVEL"],
    "storage": ["TOTAL_CAPACITY", "FLOOD_CONTROL_CAPACITY", "RESERVOIR_STORAGE", "RESERVOIR_STORAGE_START", "RESERVOIR_STORAGE_END", "RESERVOIR_STORAGE_CHANGE"],
    "discharge": ["ANNUAL_RUNOFF", "ANNUAL_RUNOFF_FLOOD_SEASON", "ANNUAL_RUNOFF_TO_SEA", "ECOLOGICAL_FLOW"],
    "power": ["POWER_GENERATION"],
    "water_supply": ["WATER_SUPPLY"],
    "water_use": ["WATER_USE", "WATER_CONSUMPTION"],
    "sediment": ["ANNUAL_SEDIMENT"],
    "precipitation": ["ANNUAL_PRECIPITATION", "LONG_TERM_AVG_PRECIPITATION"],
    "comparison": ["COMPARE_LAST_YEAR", "COMPARE_LONG_TERM_AVG", "COMPARISON"],
    "area": ["BASIN_AREA", "HAS_AREA", "GW_LEVEL_RISE_AREA", "GW_LEVEL_DECLINE_AREA"],
    "length": ["RIVER_LENGTH"],
    "water_quality": ["WATER_QUALITY"],
    "ground_depth": ["GROUNDWATER_DEPTH", "GROUNDWATER_DEPTH_START", "GROUNDWATER_DEPTH_END", "GROUNDWATER_DEPTH_CHANGE"],
}

# Parameter key by relation id, and by phrase where the id is missing.
PARAMETER_IDS = {
    "DEAD_STORAGE_LEVEL": "dead_storage_level",
    "NORMAL_STORAGE_LEVEL": "normal_storage_level",
    "FLOOD_CONTROL_LEVEL": "flood_control_level",
    "TOTAL_CAPACITY": "total_capacity",
    "FLOOD_CONTROL_CAPACITY": "flood_control_capacity",
}
PARAMETER_WORDS = [
    ("死水位", "dead_storage_level"),
    ("正常蓄水位", "normal_storage_level"),
    ("汛限", "flood_control_level"),
    ("防洪限制", "flood_control_level"),
    ("总库容", "total_capacity"),
    ("防洪库容", "flood_control_capacity"),
    ("兴利库容", "active_capacity"),
]

# Words that mark constraint phrases without a relation id, and yearly ones.
CONSTRAINT_WORDS = ["死水位", "正常蓄水位", "汛限", "防洪限制", "总库容", "防洪库容", "兴利库容"]
ANNUAL_WORDS = ["水位", "流量", "库容", "出力", "供水", "生态", "汛限", "死水位", "蓄水位", "防洪", "限制", "约束", "上限", "下限", "不超过", "不低于", "用水", "灌溉"]

# Relation ids of an indicator word.
INDICATOR_IDS = {
    "径流": ["ANNUAL_RUNOFF", "ANNUAL_RUNOFF_FLOOD_SEASON", "ANNUAL_RUNOFF_TO_SEA", "LONG_TERM_AVG_RUNOFF"],
    "流量": ["ANNUAL_RUNOFF", "ANNUAL_RUNOFF_FLOOD_SEASON", "ANNUAL_RUNOFF_TO_SEA", "ECOLOGICAL_FLOW", "LONG_TERM_AVG_RUNOFF"],
    "入流": ["ANNUAL_RUNOFF", "ANNUAL_RUNOFF_FLOOD_SEASON"],
    "水位": ["DEAD_STORAGE_LEVEL", "FLOOD_CONTROL_LEVEL", "NORMAL_STORAGE_LEVEL", "GROUNDWATER_DEPTH", "GROUNDWATER_DEPTH_START", "GROUNDWATER_DEPTH_END", "GROUNDWATER_DEPTH_CHANGE"],
    "降水": ["ANNUAL_PRECIPITATION", "LONG_TERM_AVG_PRECIPITATION"],
    "来水": ["ANNUAL_RUNOFF", "ANNUAL_RUNOFF_FLOOD_SEASON"],
}

# Ordered category words of constraint phrases.
CATEGORY_WORDS = [
    ("水位", "water_level"), ("库水位", "water_level"), ("蓄水位", "water_level"), ("汛限水位", "water_level"), ("死水位", "water_level"),
    ("正常蓄水位", "water_level"), ("防洪限制水位", "water_level"), ("库容", "storage"), ("总库容", "storage"), ("防洪库容", "storage"),
    ("兴利库容", "storage"), ("流量", "discharge"), ("下泄", "discharge"), ("泄量", "discharge"), ("径流", "discharge"), ("出力", "power_output"),
    ("发电", "power_generation"), ("供水", "water_supply"), ("用水", "water_use"), ("灌溉", "irrigation"), ("生态", "ecological_flow"),
    ("生态基流", "ecological_flow"), ("面积", "area"), ("全长", "length"), ("输沙", "sediment"),
]

# Operator words, as published (the first pattern wins) and as meant (negated forms of "below" are lower bounds).
OPERATORS_PUBLISHED = [
    ("不超过|不大于|≤|小于等于|上限|不高于|不高过|低于|小于", "<="),
    ("不低于|不小于|≥|大于等于|下限|不少于|保证|不低|高于|大于", ">="),
    ("等于|为|维持|保持|控制在?|控制在", "=="),
    ("范围|区间|之间|～|~", "between"),
]
OPERATORS_MEANT = [("不低于|不小于|不少于|不低", ">="), ("不高于|不高过|不大于|不超过", "<="), *OPERATORS_PUBLISHED]

# A number with one of the known units.
VALUE_WITH_UNIT = "(?U)(\\d+\\.?\\d*)\\s*(亿m³|亿立方米|万m³|m³/s|m³|m/s|m\\b|米|万kW|kW|亿kWh|kWh|mm|毫米|万平方公里|平方公里|km²|公顷|万亩|吨|万t|亿吨|亿t|%)?"

# Decision variable of a category; (category, name, symbol, unit).
VARIABLES = [
    ("water_level", "库水位", "Z", "m"),
    ("storage", "库容", "V", "亿m³"),
    ("discharge", "出库流量", "Q_out", "m³/s"),
    ("power_output", "出力", "P", "万kW"),
    ("power_generation", "发电量", "E", "亿kWh"),
    ("water_supply", "供水量", "W_supply", "亿m³"),
    ("water_use", "用水量", "W_use", "亿m³"),
]

# Objective candidate of a category; (category, description, direction).
OBJECTIVES = [
    ("power_generation", "最大化发电量", "maximize"),
    ("power_output", "最大化出力", "maximize"),
    ("water_supply", "最大化供水量", "maximize"),
    ("water_use", "最大化用水满足率", "maximize"),
    ("irrigation", "最大化灌溉保证率", "maximize"),
    ("ecological_flow", "最小化生态流量破坏", "minimize"),
    ("water_level", "最小化最高库水位（防洪）", "minimize"),
]

# Recognition errors and what they stand for.
TEXT_FIXES = [
    ("ALT KR] = PA eT", ""), ("AAMT AR LAA ETT EEO", ""), ("REP nk ee, PE, TB eT THT Aaa AR", ""), ("LEU TI |", ""), ("Ga AAMT AR LAA", ""),
    ("Lap Se ERS", ""), ("ROT SIM ae", ""), ("Nhe SE se AL", ""), ("nan +FtrT ND OO CC oo", ""), ("cm t+ NM De he", ""), ("当本涯以本可", ""),
    ("XING A SER TE", ""), ("SHULD BE NCSL AP", ""), ("mR ARTIS mG RAR JIE AAA", ""), ("MUN Ese", ""), ("UR", ""), ("FR 79.58", "面积 79.58"),
    ("Ay 380.3 eK", "约 380.3 mm"), ("EK,", "mm,"), ("EK", "mm"), ("™ K  tz0Z", ""), ("tz0Z", "202"), ("™", ""), ("©", ""), ("®", ""),
    ("Juk fal", ""), ("Jue gt", ""), ("Juke ge", ""), ("fuk lif", ""), ("Jak A", ""),
]

# Separators of text chunks, best first.
SEPARATORS = ["\n\n", "\n", "。", ".", "；", ";", " "]
CHUNK_SIZE, CHUNK_OVERLAP = 2000, 200

# Alias categories that are indexed, in order of precedence.
ALIAS_CATEGORIES = ["reservoirs", "hydrological_stations", "water_resource_zones", "provinces", "rivers"]

# Turn markers of chat prompts.
CHAT_OPEN, CHAT_CLOSE = "<start_of_turn>", "<end_of_turn>"
CHAT_SYSTEM = "你是资深黄河流域水库调度专家。只输出JSON数组，不输出任何解释。"
