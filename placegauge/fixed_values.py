"""Fixed values.

Every word list, lookup table, constant and pattern below must have exactly these values for
results to be right.  They are data, not logic; the modules that use them hold the logic.
"""

# --- fixed values: scoring -------------------------------------------------------------------
# Feature order is also the tie-break order of the dominant feature.
FEATURES = ("tourism", "culture", "publicFacility", "park", "library", "stationUsage")
WEIGHTS = {
    "tourism": 0.25,
    "culture": 0.20,
    "publicFacility": 0.15,
    "park": 0.10,
    "library": 0.10,
    "stationUsage": 0.20,
}
MIN_COVERAGE = 0.5
MIN_COMPARABLE_VALUES = 3
SENSITIVITY_FACTORS = (0.5, 1.5)
BAND_LARGE = 67
BAND_MEDIUM = 34

# --- fixed values: geometry ------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_008.8
GRS80_A = 6_378_137.0
GRS80_INV_F = 298.257222101
# EPSG:6677 (Japan Plane Rectangular CS IX)
ZONE_LAT0_DEG = 36.0
ZONE_LNG0_DEG = 139.0 + 50.0 / 60.0
ZONE_K0 = 0.9999
DEFAULT_RADIUS_M = 500
DEDUPE_DISTANCE_M = 150.0
UNLOCATED_TOLERANCE = 0.05
DEGRADED_BELOW = 0.5
# Valid coordinates: Tokyo with its islands.
LAT_RANGE = (20.0, 36.5)
LNG_RANGE = (136.0, 154.0)

# --- fixed values: column roles --------------------------------------------------------------
ROLE_CANDIDATES = {
    "lat": ("緯度", "lat", "latitude", "y座標", "緯度(世界測地系)"),
    "lng": ("経度", "lng", "lon", "long", "longitude", "x座標", "経度(世界測地系)"),
    "name": (
        "名称", "施設名", "施設名称", "公園名", "館名", "名前", "ページタイトル", "タイトル", "name",
    ),
    "category": (
        "文化財分類", "種類", "種別", "分類", "カテゴリ", "大分類", "小分類", "category",
    ),
    "address": ("所在地_連結表記", "所在地", "住所", "所在地_全体", "address"),
}
GEOJSON_LAT = "緯度"
GEOJSON_LNG = "経度"
READABLE_FORMATS = ("csv", "geojson", "json")

# --- fixed values: facility filters ----------------------------------------------------------
BRANCH_SUFFIXES = ("", "分館", "分室", "本館")
CROSS_MUNICIPAL_ORGS = ("東京都", "東京都建設局")
COORD_PRIORITY = {"source": 0, "geocode/exact": 1, "geocode/partial": 2}
COORD_PRIORITY_OTHER = 9

# --- fixed values: addresses -----------------------------------------------------------------
PREFECTURE = "東京都"
OTHER_PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県",
    "群馬県", "埼玉県", "千葉県", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県",
    "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県",
    "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県",
    "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県",
    "沖縄県",
)
# Municipality code -> name, all 62 of the prefecture.
MUNICIPALITIES = {
    "13101": "千代田区", "13102": "中央区", "13103": "港区", "13104": "新宿区", "13105": "文京区",
    "13106": "台東区", "13107": "墨田区", "13108": "江東区", "13109": "品川区", "13110": "目黒区",
    "13111": "大田区", "13112": "世田谷区", "13113": "渋谷区", "13114": "中野区", "13115": "杉並区",
    "13116": "豊島区", "13117": "北区", "13118": "荒川区", "13119": "板橋区", "13120": "練馬区",
    "13121": "足立区", "13122": "葛飾区", "13123": "江戸川区", "13201": "八王子市",
    "13202": "立川市", "13203": "武蔵野市", "13204": "三鷹市", "13205": "青梅市",
    "13206": "府中市", "13207": "昭島市", "13208": "調布市", "13209": "町田市",
    "13210": "小金井市", "13211": "小平市", "13212": "日野市", "13213": "東村山市",
    "13214": "国分寺市", "13215": "国立市", "13218": "福生市", "13219": "狛江市",
    "13220": "東大和市", "13221": "清瀬市", "13222": "東久留米市", "13223": "武蔵村山市",
    "13224": "多摩市", "13225": "稲城市", "13227": "羽村市", "13228": "あきる野市",
    "13229": "西東京市", "13303": "瑞穂町", "13305": "日の出町", "13307": "檜原村",
    "13308": "奥多摩町", "13361": "大島町", "13362": "利島村", "13363": "新島村",
    "13364": "神津島村", "13381": "三宅村", "13382": "御蔵島村", "13401": "八丈町",
    "13402": "青ヶ島村", "13421": "小笠原村",
}
OUTSIDE_AREA_FORMAT = "(都外 {code})"
COUNTY_PATTERN = "^[^\\s]{1,4}郡"
KANJI_DIGITS = "〇一二三四五六七八九"
KANJI_TEN = "十"
HYPHEN_PATTERN = "[‐‑‒–—―−ーｰ－-]"
BLOCK_WORDS_PATTERN = "(丁目|番地|番|号)"
BLOCK_WORD = "丁目"
AREA_SEPARATORS_PATTERN = "[/／、・;；]"
AND_OTHERS_PATTERN = "(ほか|他|外)$"
IN_FRONT_PATTERN = "先$"

# --- fixed values: unlocated reasons, dataset and verdict states -------------------------------
NO_ADDRESS = "no-address"
OUTSIDE_REGION = "outside-tokyo"
OUT_OF_SCOPE = "out-of-geocode-scope"
LOOKUP_ERROR = "geocode-error"
NOT_FOUND = "geocode-not-found"
STATUSES = ("accepted", "review", "rejected")
INGEST_STATUSES = ("ok", "degraded", "failed", "out-of-scope", "no-matching-rows")

# --- fixed values: dataset evaluation --------------------------------------------------------
FORMAT_SCORES = {
    "GEOJSON": 0.9, "JSON": 0.9, "CSV": 0.8, "KML": 0.7, "XLSX": 0.6, "XLS": 0.6,
}
DATASTORE_SCORE = 1.0
OPEN_LICENSE_IDS = ("cc-by-4.0", "cc-by", "cc-by-2.1-jp", "cc0-1.0", "cc0", "odc-by")
OPEN_LICENSE_WORDS = ("CC BY", "CC0", "表示", "政府標準利用規約", "公共データ利用規約")
SIGNAL_WEIGHTS = {
    "semantic": 0.35, "format": 0.15, "location": 0.30, "license": 0.10, "freshness": 0.10,
}
ACCEPT_CONFIDENCE = 0.75
ACCEPT_MIN_SEMANTIC = 0.7
ACCEPT_MIN_FILL = 0.8
ACCEPT_MIN_LOCATION = 0.8
GEOCODE_LOCATION = 0.8
UNKNOWN_LOCATION = 0.5
DATASET_MIN_CONFIDENCE = 0.7
DATASET_MIN_LIST = 0.45
DATASET_REJECT_LIST = 0.3
FACILITY_MIN_CONFIDENCE = 0.5
MIXED = "mixed"

# --- fixed values: ridership and rail sites ----------------------------------------------------
ERA_START = {"令和": 2018, "平成": 1988}
ERA_FIRST_YEAR = "元"
YEARBOOK_ORG = "東京都総務局"
YEARBOOK_WORD = "運輸"
TABLE_MARKERS = ("駅別乗車人員", "駅別乗降車人員")
DEFAULT_OPERATOR = "JR東日本"
YEARBOOK_REASON = "東京都統計年鑑（運輸）の最新年パッケージ。駅別表: "
YEARBOOK_NAME_SEPARATOR = "・"
OPERATOR_SHORT = {
    "東日本旅客鉄道": "JR",
    "東海旅客鉄道": "JR東海",
    "東京地下鉄": "東京メトロ",
    "東京都": "都営",
    "首都圏新都市鉄道": "",
    "東京臨海高速鉄道": "",
    "東京モノレール": "",
    "ゆりかもめ": "",
}

# --- fixed values: feature definitions ---------------------------------------------------------
GLOBAL_EXCLUDE_KEYWORDS = (
    "統計年鑑", "審議会", "世論調査", "行政資料集", "基礎資料集", "会議", "整備方針", "計画",
    "事業概要", "事務所概要", "事業一覧", "実態調査", "行動特性調査", "利用状況", "バリアフリー",
    "エレベーター", "イベント", "喫煙", "介護",
)
FEATURE_DEFINITIONS = {
    "park": {
        "keywords": ("公園", "児童遊園", "緑地"),
        "list_hints": ("一覧", "リスト", "所在地", "位置"),
        "exclude_keywords": (
            "推移", "画像", "写真", "樹木", "点群", "配置図", "工事", "予算", "利用者数",
            "入場者数", "面積別", "設置状況", "数と面積", "数及び面積", "面積・人口", "トイレ",
            "便所", "駐車場", "駐輪場",
        ),
    },
    "culture": {
        "keywords": ("文化財", "文化施設", "博物館", "資料館", "美術館"),
        "list_hints": ("一覧", "リスト", "所在地"),
        "exclude_keywords": ("推移", "画像", "写真", "予算", "埋蔵", "包蔵地"),
        "exclude_names": (
            "体育館", "スポーツセンター", "運動場", "野球場", "テニスコート", "プール", "公園",
            "図書館",
        ),
        "exclude_markers": ("非公開",),
        "exclude_categories": ("無形",),
        "same_place_m": 30.0,
    },
    "publicFacility": {
        "keywords": (
            "公共施設", "地域センター", "区民館", "集会施設", "公会堂", "区民センター",
        ),
        "list_hints": ("一覧", "リスト", "所在地", "情報"),
        "exclude_keywords": (
            "推移", "画像", "写真", "予算", "白書", "回収", "AED", "トイレ", "Wi-Fi", "wifi",
            "喫煙", "避難", "自動販売機", "投票所",
        ),
        "exclude_names": ("公園", "児童遊園", "緑地", "図書館"),
        "include_names": (
            "区民館", "区民会館", "区民センター", "地域センター", "出張所", "集会所", "集会室",
            "会館", "公会堂", "ホール", "交流", "コミュニティ", "プラザ", "児童館",
        ),
        "exclude_markers": (
            "便所", "トイレ", "倉庫", "備蓄", "ストックヤード", "事務室", "住宅", "駐輪", "駐車",
            "旧",
        ),
        "same_place_m": 30.0,
    },
    "tourism": {
        "keywords": ("観光", "名所", "観光施設", "観光スポット"),
        "list_hints": ("一覧", "リスト", "所在地"),
        "exclude_keywords": (
            "推移", "統計", "入込", "画像", "写真", "予算", "トイレ", "ルート", "調査",
        ),
    },
    "library": {
        "keywords": ("図書館",),
        "list_hints": ("一覧", "リスト", "所在地"),
        "exclude_keywords": (
            "推移", "蔵書", "貸出", "利用者数", "予算", "移動図書館", "巡回",
        ),
    },
}

# --- fixed values: reason texts and display texts ----------------------------------------------
REASON_SEPARATOR = "。"
QUOTE_SEPARATOR = "」「"
REASON_TITLE_LIST = "タイトルに「{words}」を含む"
REASON_TITLE = "タイトルに「{words}」を含む（一覧を示す語なし）"
REASON_RESOURCE = "リソース名に「{words}」を含む（カテゴリ別ファイル）"
REASON_NOTES = "説明・タグのみに「{words}」を含む"
REASON_NO_KEYWORD = "キーワードに一致しない"
REASON_NO_RESOURCE = "機械可読なリソースがない（PDF・画像等のみ）"
REASON_EXCLUDED = "除外語「{words}」を含む"
REASON_UPDATED = "更新 {date}"
REASON_DUPLICATE = "。{original} と重複の可能性"
NO_SCORE_TEXT = "—"
NO_RAW_TEXT = "欠損"

# How an item is described when the classifier is asked about it.
ITEM_STATE = {
    "facility": ["施設名", "種別", "出典の一覧"],
    "dataset": ["データセット名", "提供組織", "列"],
}
NO_CATEGORIES = "（なし）"
NO_COLUMNS = "（不明）"

# How a reason tells what the classifier said.
CLASSIFIER = "classifier"
NOTE_CONFIDENCE = "（確信度 "
NOTE_LIST = "、一覧 "
NOTE_END = "）"
NOTE_FAILED = " 失敗: "
NOTE_ACCEPTED = " → 採用"
NOTE_REJECTED = " → 不採用"
NOTE_NO_PLACE = "。位置情報が不足のため要確認のまま"
NOTE_UNSURE = "。判断が分かれるため要確認のまま"
