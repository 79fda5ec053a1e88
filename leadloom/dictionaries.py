"""Word lists, lookup tables, thresholds and patterns.

Everything in this module is a FIXED VALUE: results depend on these exact
entries, so they are stated as plain text in their natural order.  Every
operator takes the table it needs as a parameter and uses the entry here only
as its default.
"""

# --- fixed values: phone numbers -------------------------------------------
MOBILE_PREFIXES = [
    "032", "033", "034", "035", "036", "037", "038", "039",
    "056", "058", "059",
    "070", "076", "077", "078", "079",
    "081", "082", "083", "084", "085", "086", "088", "089",
    "090", "091", "092", "093", "094", "096", "097", "098", "099",
]

# Landline area code -> province.  Two codes are assigned twice in the source
# list (0290, 0261); the later assignment is the one in force.
LANDLINE_PROVINCE = {
    "024": "Ha Noi",
    "028": "TP. Ho Chi Minh",
    "0220": "Quang Ninh",
    "0221": "Hai Duong",
    "0222": "Bac Ninh",
    "0225": "Hai Phong",
    "0226": "Hung Yen",
    "0227": "Ha Nam",
    "0228": "Nam Dinh",
    "0229": "Ninh Binh",
    "0232": "Quang Nam",
    "0233": "Thai Binh",
    "0234": "Thua Thien Hue",
    "0235": "Quang Nam",
    "0236": "Da Nang",
    "0251": "Dong Nai",
    "0252": "Binh Thuan",
    "0254": "Ba Ria - Vung Tau",
    "0255": "Quang Ngai",
    "0256": "Binh Dinh",
    "0257": "Phu Yen",
    "0258": "Khanh Hoa",
    "0259": "Ninh Thuan",
    "0260": "Kon Tum",
    "0261": "Dak Nong",
    "0262": "Dak Lak",
    "0263": "Lam Dong",
    "0270": "Vinh Long",
    "0271": "Binh Phuoc",
    "0272": "Long An",
    "0273": "Tien Giang",
    "0274": "Binh Duong",
    "0275": "Dong Thap",
    "0276": "Tay Ninh",
    "0290": "Ca Mau",
    "0291": "Ben Tre",
    "0292": "Can Tho",
    "0293": "Soc Trang",
    "0294": "Hau Giang",
    "0295": "Bac Lieu",
    "0296": "Tra Vinh",
    "0297": "Kien Giang",
}

# --- fixed values: provinces in addresses ----------------------------------
# Word groups tried first, in this order.
PROVINCE_PRIORITY = [
    ("TP. Hồ Chí Minh", ["sg", "ho chi minh", "hcm", "sài gòn"]),
    ("Hà Nội", ["hn", "ha noi", "hà nội"]),
    ("Đà Nẵng", ["đn", "da nang", "đà nẵng"]),
]
# Then the first of these names that occurs in the text.
PROVINCE_NAMES = [
    "Hà Nội", "Hồ Chí Minh", "HCM", "Sài Gòn", "Đà Nẵng", "Hải Phòng", "Cần Thơ",
    "Bình Dương", "Đồng Nai", "Bà Rịa", "Vũng Tàu", "Khánh Hòa", "Nha Trang",
    "Quảng Ninh", "Tây Ninh", "Bình Phước", "Long An", "Tiền Giang", "Bến Tre",
    "Trà Vinh", "Vĩnh Long", "Đồng Tháp", "An Giang", "Kiên Giang", "Cà Mau",
    "Bạc Liêu", "Sóc Trăng", "Hậu Giang", "Lâm Đồng", "Đà Lạt", "Đắk Lắk",
    "Buôn Ma Thuột", "Đắk Nông", "Gia Lai", "Pleiku", "Kon Tum", "Phú Yên",
    "Bình Định", "Quy Nhơn", "Quảng Ngãi", "Quảng Nam", "Thừa Thiên Huế", "Huế",
    "Quảng Trị", "Quảng Bình", "Hà Tĩnh", "Nghệ An", "Vinh", "Thanh Hóa",
    "Ninh Bình", "Nam Định", "Thái Bình", "Hà Nam", "Hưng Yên", "Hải Dương",
    "Bắc Ninh", "Vĩnh Phúc", "Bắc Giang", "Thái Nguyên", "Phú Thọ", "Tuyên Quang",
    "Hà Giang", "Cao Bằng", "Bắc Kạn", "Lạng Sơn", "Hòa Bình", "Sơn La",
    "Điện Biên", "Lai Châu", "Lào Cai", "Yên Bái",
]
# Names that stand for another province.
PROVINCE_ALIASES = {
    "Bà Rịa": "Bà Rịa - Vũng Tàu",
    "Vũng Tàu": "Bà Rịa - Vũng Tàu",
    "Nha Trang": "Khánh Hòa",
    "Đà Lạt": "Lâm Đồng",
    "Buôn Ma Thuột": "Đắk Lắk",
    "Pleiku": "Gia Lai",
    "Quy Nhơn": "Bình Định",
    "Huế": "Thừa Thiên Huế",
    "Vinh": "Nghệ An",
}
# Provinces counted on the snapshot, and the name of the remainder.
SNAPSHOT_PROVINCES = ["Hà Nội", "Hồ Chí Minh", "Đà Nẵng", "Bình Dương",
                      "Đồng Nai", "Nghệ An", "Hải Phòng", "Cần Thơ"]
SNAPSHOT_OTHER = "Tỉnh khác"

# --- fixed values: contact files -------------------------------------------
# Canonical column -> header words; a header is used for one column only and
# columns are resolved in this order.
HEADER_WORDS = {
    "name": ["họ tên", "full name", "tên", "customer name", "khách hàng", "họ và tên",
             "tên khách hàng", "first name", "last name", "họ", "đệm"],
    "phone": ["số điện thoại", "sđt", "phone", "mobile", "tel", "di động", "contact",
              "số đt", "điện thoại", "tổng số"],
    "email": ["email", "thư điện tử", "e-mail", "địa chỉ email"],
    "address": ["địa chỉ", "address", "địa chỉ thường trú", "thường trú", "location", "đv"],
    "source": ["nguồn", "source", "origin", "nguồn khách"],
    "campaign": ["chiến dịch", "campaign", "ad name", "ad set", "tên chiến dịch"],
    "date": ["ngày", "date", "ngày tạo", "created at", "ngay", "time"],
    "note": ["ghi chú", "note", "comment", "yêu cầu", "nội dung", "request"],
    "fb_uid": ["fb_uid", "uid facebook", "uid", "facebook id", "id facebook", "fb id"],
    "fb_link": ["link facebook", "facebook link", "fb link", "link fb", "fb_link",
                "trang cá nhân", "profile"],
}
IDENTITY_UID_WORDS = ["uid", "facebook id", "fb id", "link fb", "link facebook", "profile"]
IDENTITY_NAME_WORDS = ["name", "tên", "họ tên", "full name", "firstname", "last name", "customer"]
IDENTITY_PHONE_WORDS = ["phone", "sđt", "số điện thoại", "mobile", "tel", "liên hệ", "contact"]
DATA_EXTENSIONS = ["xlsx", "xls", "csv", "txt", "doc", "docx"]
NULL_NAME_WORDS = ["nan", "none", "null", "unknown"]
LOCALE_WORDS = ["vi_VN", "en_US", "vi", "en", "VN", "US"]
SOURCE_WORDS = [
    ("Facebook", ["facebook", "fb "]),
    ("Google", ["google", "gg "]),
    ("Zalo", ["zalo"]),
    ("TikTok", ["tikt"]),
]
REASON_MISSING = "Thiếu cả SĐT và Email"
REASON_INVALID_PHONE = "SĐT không hợp lệ: "
REASON_DUPLICATE = "Trùng lặp (Duplicate)"
EXPORT_COLUMNS = ["name", "phone", "email", "address", "province", "source",
                  "campaign", "date", "note", "file_origin"]
VIP_WORDS = ["biệt thự", "villa", "land rover", "lexus", "audi", "mercedes", "bmw",
             "shophouse", "penthouse", "the manor", "phú mỹ hưng", "savill", "vip"]

# --- fixed values: source tiers of file names ------------------------------
# (tier, weight, label, code for the feature matrix, patterns)
TIERS = [
    ("banking_vip", 1.00, "Ngan hang VIP", 8, [
        r"(HSBC|ACB|VCB|VIB|Techcombank|BIDV|Sacombank|MBBank|VPBank|Ocb|Msb|TPBank)",
        r"(tiet[_\s\-]?kiem|tiet\.?kiem)",
        r"(co[_\s]?dong|co[_\s]?tuc|chia[_\s]?co[_\s]?tuc)",
        r"(ngan[_\s]?hang|banking).*(vip|cao[_\s]?cap|elite|priority)",
        r"ANZ|LienViet|SeABank|MaritimeBank|BaoViet|VietBank|Manulife|MNL|Chubb|AIA|Prudential",
        r"(private[_\s]?banking|priority[_\s]?banking)",
    ]),
    ("real_estate_vip", 0.95, "BDS Cao Cap", 7, [
        r"Vinhomes|Novaland|NovaWorld|Masteri|HAGL|Hoang[_\s]?Anh[_\s]?Gia[_\s]?Lai",
        r"(biet[_\s]?thu|bietthu|villa|penthouse|shophouse|duplex)",
        r"(him[_\s]?lam|saigon[_\s]?pearl|times[_\s]?city|royal[_\s]?city)",
        r"(the[_\s]?manor|the[_\s]?tresor|sky[_\s]?center|midtown|Wilton|Riverview)",
        r"(phu[_\s]?my[_\s]?hung|diamond[_\s]?island|Riviera|Ehome|Phu[_\s]?Gia|KDC)",
        r"CBRE|Savills|JLL|Colliers",
        r"(resort|nghỉ[_\s]?dưỡng|nghi[_\s]?duong).*(can[_\s]?ho|chung[_\s]?cu|biet[_\s]?thu)",
    ]),
    ("ceo_director", 0.90, "CEO / Giam Doc", 7, [
        r"(giam[_\s]?doc|GiamDoc|giamDoc|Ke[_\s]?toan[_\s]?truong)",
        r"(CEO|chu[_\s]?tich|lanh[_\s]?dao|doanh[_\s]?nhan)",
        r"CLB.*(2030|YBA|SG|Dat[_\s]?Viet|doanh|lanh)",
        r"(quan[_\s]?ly[_\s]?cao|cap[_\s]?cao|c[_\-]?level)",
        r"(director|manager|president|founder|co[_\-]?founder)",
        r"(ACCA|MBA|CFA|CPA).*(list|danh|KH)",
        r"(ca[_\s]?si|nguoi[_\s]?noi[_\s]?tieng)",
    ]),
    ("automotive_vip", 0.80, "O To Cao Cap", 5, [
        r"(BMW|Mercedes|Lexus|Land[_\s]?Rover|Audi|Porsche|Bentley|Ferrari|Maserati)",
        r"(xe[_\s]?sang|xe[_\s]?vip|xe[_\s]?cao[_\s]?cap|luxury[_\s]?car)",
        r"(TOYOTA|FORD|HONDA).*(giam[_\s]?doc|vip|private|cao[_\s]?cap)",
    ]),
    ("stock_gold", 0.80, "Chung Khoan / Vang", 5, [
        r"(chung[_\s]?khoan|ChungKhoan|co[_\s]?phieu|coPhieu)",
        r"(HOSE|HNX|UPCOM|VN-?Index)",
        r"(san[_\s]?vang|vang[_\s]?vat[_\s]?chat|dau[_\s]?tu[_\s]?vang)",
        r"(VGB|NDT|nha[_\s]?dau[_\s]?tu|quỹ[_\s]?đầu[_\s]?tư)",
        r"(SSI|VPS|VCSC|Dragon[_\s]?Capital|VinaCapital|HSC|TVSI|vndirect|MBS)",
    ]),
    ("fitness_health", 0.65, "Fitness / Suc Khoe", 4, [
        r"(gym|fitness|yoga|pilates|zumba|Golf)",
        r"(25[_\s]?FIT|King[_\s]?Fitness|California|Crunch|Anytime)",
        r"(InBody|The[_\s]?Gym|Chivas|Citimart[_\s]?Health)",
        r"(spa|tham[_\s]?my|tham\.?my|sac[_\s]?dep|beauty|skincare)",
        r"(benh[_\s]?vien|hospital).*(vip|quoc[_\s]?te|international|FV|Vinmec|Hong[_\s]?Ngoc)",
    ]),
    ("education_hr", 0.50, "Giao duc / HR", 3, [
        r"(Vietnamwork|TimViecNhanh|CareerBuilder|TopCV)",
        r"(tuyen[_\s]?dung|tuyendung|nhan[_\s]?su|nhanSu)",
        r"(PACE|hoc[_\s]?vien|DH|dai[_\s]?hoc|truong[_\s]?dai[_\s]?hoc)",
        r"(ung[_\s]?vien|ungvien|chung[_\s]?chi|certificate)",
        r"(du[_\s]?hoc|study[_\s]?abroad|ielts|toefl|GMAT)",
    ]),
    ("telecom_mass", 0.40, "Thue Bao Vien Thong", 2, [
        r"(Viettel|Mobifone|Vinaphone|Vietnamobile|Gmobile|Reddi)",
        r"(thue[_\s]?bao|thuebao|tra[_\s]?sau|trasau|sim[_\s]?data)",
        r"(MOBI|VINA|VIET|VTT).*(TPHCM|HCM|HN|HaNoi|QB|DN|TP)",
        r"(dien[_\s]?thoai|smartphone).*(kh|danh[_\s]?sach|list)",
    ]),
]
UNKNOWN_TIER = ("unknown", 0.25, "Chua Phan Loai", 1)

# --- fixed values: file audit ----------------------------------------------
FILE_CATEGORIES = [
    ("Doanh nhân / CLB / Quản lý", ["doanh nhan", "cap cao", "quan ly", "ceo", "yba", "2030",
                                    "clb", "phong thuong mai", "chu doanh nghiep", "lanh dao",
                                    "founder", "giam doc"]),
    ("BĐS / Dự án cao cấp", ["vinhomes", "bds", "him lam", "phu my hung", "lakeview", "sunrise",
                             "ghv", "chung cu", "dat nen", "biet thu", "nha pho", "park", "eco",
                             "novaland"]),
    ("Tài chính / Vip Bank", ["tiet kiem", "ngan hang", "bank", "credit", "uu tien",
                              "the tin dung", "sacom", "techcom", "vpb", "vib", "vay",
                              "tai chinh"]),
    ("Sức khỏe / Siêu giàu / Golf", ["golf", "inbody", "fitness", "gym", "yoga", "california",
                                     "diamond", "gold", "platinum"]),
    ("Định danh / Facebook API", ["uid", "fb", "facebook", "profile", "link", "id", "convert"]),
    ("Việc làm / Giáo dục", ["vietnamwork", "tuyen dung", "job", "hr", "du hoc", "giao duc"]),
]
FILE_UNCATEGORISED = "Chưa phân loại"
FILE_MEANINGLESS = "Vô nghĩa (Đã di chuyển)"
GENERIC_FILE_WORDS = ["data", "sheet", "book", "file", "copy of", "ban sao", "test",
                      "new microsoft", "untitled", "123", "abc", "final", "final2", "fix",
                      "updated"]

# --- fixed values: interactions and listings -------------------------------
BEHAVIOR_WEIGHTS = {"comment": 3.0, "tag": 2.5, "share": 2.0, "like": 0.5}
LISTING_DOMAINS = ["batdongsan.com.vn", "nha.com.vn", "alonhadat.com.vn", "muanhadat.vn",
                   "homedy.com", "nhadatso.com", "chotot.com"]

# --- fixed values: clustering ----------------------------------------------
INTEREST_WORDS = {
    "speculation": ["đất nền", "đất tỉnh", "quy hoạch", "đầu tư", "lô đất", "mặt tiền",
                    "đất ven biển", "tái định cư"],
    "home": ["chung cư", "căn hộ", "nhà phố", "trường học", "bệnh viện", "tiện ích", "ở thực",
             "an cư", "bé con"],
    "vip": ["biệt thự", "nghỉ dưỡng", "villa", "penthouse", "resort", "hạng sang", "cao cấp",
            "luxury", "shophouse"],
}
CLUSTER_LABELS = {0: "Standard", 1: "Growth", 2: "VIP"}
UNCLUSTERED_LABEL = "Chưa phân"
PERSONAS = {
    "hnw": "💎 High-Net-Worth VIP",
    "business": "🏢 Professional / Business",
    "cross": "🕵️ Cross-Referenced Potential",
    "finance": "🏦 Banking/Finance Focused",
    "multichannel": "🔄 Active Multichannel",
    "mass": "👤 General/Mass Market",
}

# --- fixed values: unified score -------------------------------------------
GRADES = [(85, "S", "VIP Elite — Giao Sales giỏi nhất, gọi ngay"),
          (70, "A", "Hot Lead — Ưu tiên cao, gọi trong tuần"),
          (55, "B", "Warm Lead — Theo dõi, nurture"),
          (40, "C", "Cold Lead — Mass outreach / email"),
          (0, "D", "Very Cold — Lưu trữ / bỏ qua")]
GRADE_BUCKETS = {"S": "S (85-100) VIP Elite", "A": "A (70-84) Hot Lead",
                 "B": "B (55-69) Warm Lead", "C": "C (40-54) Cold Lead",
                 "D": "D (<40) Archive"}
RFM_SEGMENTS = [(9.0, "Champions"), (7.5, "Loyal"), (6.0, "Potential Loyalist"),
                (4.5, "At Risk"), (3.0, "Hibernating"), (None, "Lost")]

# --- fixed values: advertising ---------------------------------------------
COST_BENCHMARKS = {
    "cpl": (150000.0, 400000.0), "cpm": (50000.0, 100000.0), "cpc": (5000.0, 15000.0),
    "ctr": (2.0, 1.0), "frequency": (2.5, 3.5), "conv_rate": (8.0, 4.0),
}
HIGHER_IS_BETTER = ("ctr", "conv_rate")
CONTENT_BENCHMARKS = {
    "cpl_good": 150000, "cpl_poor": 400000, "ctr_good": 2.0, "ctr_poor": 1.0,
    "quality_good": 7.0, "quality_poor": 4.0, "freq_good": 2.5, "freq_warn": 3.5,
}
BUDGET_RULES = {
    "pause_cpl": 500000.0, "pause_quality": 4.0, "scale_cpl": 150000.0, "scale_quality": 7.0,
    "scale_factor": 1.5, "ctr_poor": 1.0, "ctr_budget_cut": 0.7, "freq_cap": 3.5,
    "winner_quality": 8.0, "winner_budget": 2.0,
}
QUADRANTS = [("SCALE_UP", "🟢 Nhân rộng ngay"), ("OPTIMIZE_TARGETING", "🟡 Tối ưu targeting"),
             ("TEST_CREATIVE", "🟡 Test creative mới"), ("PAUSE", "🔴 Nên dừng ngay")]
# content type -> (label, format)
CONTENT_TYPES = {
    "video_testimonial": ("Video — KH thực tế", "video"),
    "video_luxury": ("Video — Luxury/VIP", "video"),
    "video_drone": ("Video — Drone/Dự án", "video"),
    "video_resort": ("Video — Nghỉ dưỡng", "video"),
    "video_lifestyle": ("Video — Lifestyle", "video"),
    "video_short": ("Video — 15s TOFU", "video"),
    "video_vip": ("Video — Ultra VIP", "video"),
    "carousel_project": ("Carousel — Dự án", "carousel"),
    "image_roi": ("Image — ROI/Đầu tư", "image"),
    "image_price": ("Image — Giá/Ưu đãi", "image"),
    "image_view": ("Image — View/Tiện ích", "image"),
    "image_map": ("Image — Bản đồ/Vị trí", "image"),
    "personal_brand": ("Personal Brand — Agent", "personal"),
    "countdown_creative": ("Countdown/Urgency", "creative"),
    "roi_calculator": ("ROI Calculator", "creative"),
    "lal_creative": ("Lookalike Audience", "audience"),
    "retarget": ("Retarget — Custom Audience", "audience"),
    "ab_test": ("A/B Test Creative", "creative"),
    "tech_creative": ("Tech/Smart Home", "creative"),
    "smart_creative": ("Smart ROAS", "creative"),
    "mass_creative": ("Mass Interest", "creative"),
    "international": ("International Audience", "creative"),
    "premium_creative": ("Premium/Luxury Static", "creative"),
    "lifestyle_creative": ("Lifestyle — Travel", "creative"),
    "story_beach": ("Story — Beachfront", "creative"),
    "document_creative": ("Pháp lý/Trust", "creative"),
    "launch_creative": ("Launch Campaign", "creative"),
    "interest_segment": ("Interest Segment", "audience"),
}
CONTENT_FORMATS = ["video", "carousel", "image", "personal", "audience", "creative", "other"]
LEAD_ACTION_TYPES = ["lead", "onsite_conversion.lead_grouped"]

# --- fixed values: chat ----------------------------------------------------
HIGH_INTENT_WORDS = ["mua", "đặt cọc", "cọc", "giá bao nhiêu", "diện tích", "căn hộ", "vốn",
                     "lãi suất", "thanh toán", "hỗ trợ vay", "bao giờ bàn giao", "pháp lý",
                     "sổ đỏ", "sổ hồng", "chính sách", "chiết khấu", "xem nhà", "xem dự án",
                     "đặt lịch", "tư vấn", "đầu tư"]
MEDIUM_INTENT_WORDS = ["thông tin", "dự án", "vị trí", "khu vực", "đường", "quận", "cho thuê",
                       "giá", "bao nhiêu", "hướng", "tầng", "view"]
# category -> (weight in the composite, label)
INTENT_CATEGORIES = {
    "TRANSACTION": (0.35, "Mua/Chốt"),
    "SCHEDULING": (0.25, "Lịch hẹn"),
    "QUALIFICATION": (0.20, "Tài chính"),
    "LEGAL_CHECK": (0.10, "Pháp lý"),
    "RESEARCH": (0.10, "Tìm hiểu"),
    "CONCERN": (0.00, "Lo ngại"),
}
# (category, pattern, score, label)
INTENT_SIGNALS = [
    ("TRANSACTION", r"(muốn|tôi\s+đặt|muốn\s+đặt)\s*(cọc|mua)", 10, "Muốn đặt cọc/mua"),
    ("TRANSACTION", r"(chốt|ký\s*hợp\s*đồng|mua\s*ngay|đồng\s*ý\s*mua)", 10, "Tín hiệu chốt deal"),
    ("TRANSACTION", r"(đặt\s*cọc|cọc\s*bao\s*nhiêu|đặt\s*giữ\s*chỗ)", 9, "Hỏi đặt cọc"),
    ("TRANSACTION", r"(tôi\s*lấy|mình\s*lấy|anh\s*lấy|chị\s*lấy)\s*căn", 9, "Xác nhận muốn lấy căn"),
    ("TRANSACTION", r"(gửi\s*hợp\s*đồng|xem\s*hợp\s*đồng|điều\s*khoản)", 8, "Hỏi hợp đồng"),
    ("TRANSACTION", r"(anh\s*chị\s*quan\s*tâm|mình\s*quan\s*tâm|tôi\s*quan\s*tâm).{0,20}này", 7, "Xác nhận quan tâm"),
    ("TRANSACTION", r"(giá\s*(căn|phòng|nhà|đó|này|bao\s*nhiêu)|báo\s*giá|bảng\s*giá)", 7, "Hỏi giá cụ thể"),
    ("TRANSACTION", r"(phương\s*thức\s*thanh\s*toán|lịch\s*thanh\s*toán|trả\s*góp)", 8, "Hỏi thanh toán"),
    ("TRANSACTION", r"(còn\s*(hàng|căn|suất|slot)|còn\s*không|còn\s*bán\s*không)", 7, "Hỏi còn hàng"),
    ("TRANSACTION", r"(so\s*sánh|cân\s*nhắc|đang\s*xem\s*xét).{0,30}(dự\s*án|căn)", 5, "Đang so sánh dự án"),
    ("TRANSACTION", r"(anh\s*chị\s*đang\s*tìm|mình\s*đang\s*tìm)\s*(nhà|căn|đất)", 5, "Đang tìm kiếm"),
    ("SCHEDULING", r"(đặt\s*lịch|book\s*lịch|hẹn\s*xem|xem\s*nhà\s*mẫu|xem\s*trực\s*tiếp)", 10, "Muốn đặt lịch xem"),
    ("SCHEDULING", r"(cuối\s*tuần\s*(này|tới)|thứ\s*[2-7bcdsbtbn]|sáng|chiều|tối)\s*(nào|này|mai|kia)", 9, "Đề xuất thời gian cụ thể"),
    ("SCHEDULING", r"(gặp\s*(trực\s*tiếp|anh|chị|sales|nhân\s*viên)|gặp\s*mặt)", 9, "Muốn gặp trực tiếp"),
    ("SCHEDULING", r"(tham\s*quan|đến\s*xem|muốn\s*xem|đến\s*dự\s*án)", 8, "Muốn đến xem dự án"),
    ("SCHEDULING", r"(khi\s*nào\s*(có\s*thể|được)|lúc\s*nào\s*tiện)", 6, "Hỏi thời gian hẹn"),
    ("SCHEDULING", r"(gọi\s*lại|liên\s*hệ\s*lại|gọi\s*cho\s*tôi)", 7, "Yêu cầu liên hệ lại"),
    ("SCHEDULING", r"(zalo|số\s*điện\s*thoại|contact|liên\s*lạc)\s*(của|anh|chị|bạn)", 7, "Xin thông tin liên lạc"),
    ("SCHEDULING", r"(tư\s*vấn\s*thêm|giải\s*thích\s*thêm|nói\s*chuyện)", 5, "Muốn tư vấn thêm"),
    ("QUALIFICATION", r"ngân\s*sách.{0,20}(\d+[\.,]?\d*)\s*(tỷ|triệu|tr|t)", 10, "Tự cung cấp ngân sách"),
    ("QUALIFICATION", r"tầm\s*(\d+[\.,]?\d*)\s*(tỷ|triệu|tr)", 9, "Cung cấp ngân sách tầm"),
    ("QUALIFICATION", r"(budget|dự\s*toán).{0,10}(\d+)", 9, "Đề cập budget"),
    ("QUALIFICATION", r"(\d+[\.,]?\d*)\s*tỷ\s*(được\s*không|có\s*không|phù\s*hợp)", 9, "Xác nhận budget cụ thể"),
    ("QUALIFICATION", r"(vay\s*(ngân\s*hàng|tiền|vốn)|cho\s*vay|hỗ\s*trợ\s*vay)", 8, "Hỏi chính sách vay"),
    ("QUALIFICATION", r"(lãi\s*suất|ưu\s*đãi\s*vay|gói\s*vay|tín\s*dụng)", 8, "Hỏi lãi suất/vay"),
    ("QUALIFICATION", r"(trả\s*trước|vốn\s*tự\s*có|equity|đặt\s*trước\s*bao\s*nhiêu)", 8, "Hỏi vốn ban đầu"),
    ("QUALIFICATION", r"(khả\s*năng\s*tài\s*chính|tài\s*chính\s*của\s*tôi|thu\s*nhập)", 6, "Đề cập tài chính cá nhân"),
    ("QUALIFICATION", r"(phí\s*(quản\s*lý|bảo\s*trì|dịch\s*vụ)|chi\s*phí\s*hàng\s*tháng)", 5, "Hỏi chi phí phát sinh"),
    ("LEGAL_CHECK", r"(sổ\s*(hồng|đỏ)|giấy\s*chứng\s*nhận|cấp\s*sổ)", 9, "Hỏi sổ hồng/pháp lý"),
    ("LEGAL_CHECK", r"(pháp\s*lý|pháp\s*lí|tính\s*pháp\s*lý|hồ\s*sơ\s*pháp\s*lý)", 9, "Hỏi pháp lý"),
    ("LEGAL_CHECK", r"(quy\s*hoạch|không\s*trong\s*lộ\s*giới|tranh\s*chấp|kiện)", 8, "Hỏi quy hoạch"),
    ("LEGAL_CHECK", r"(chủ\s*đầu\s*tư\s*uy\s*tín|uy\s*tín\s*của\s*chủ|bảo\s*lãnh\s*ngân\s*hàng)", 8, "Hỏi uy tín CĐT"),
    ("LEGAL_CHECK", r"(bàn\s*giao\s*(khi\s*nào|tháng|quý|năm)|tiến\s*độ\s*xây\s*dựng)", 8, "Hỏi tiến độ bàn giao"),
    ("LEGAL_CHECK", r"(phạt\s*chậm\s*bàn\s*giao|cam\s*kết\s*bàn\s*giao|đúng\s*tiến\s*độ)", 7, "Hỏi cam kết tiến độ"),
    ("LEGAL_CHECK", r"(hợp\s*đồng\s*(mua\s*bán|đặt\s*cọc|chuyển\s*nhượng))", 7, "Hỏi loại hợp đồng"),
    ("RESEARCH", r"(dự\s*án\s*(này|đó|ở\s*đâu|như\s*thế\s*nào)|thông\s*tin\s*dự\s*án)", 4, "Hỏi thông tin dự án"),
    ("RESEARCH", r"(diện\s*tích|số\s*phòng|bao\s*nhiêu\s*(phòng|tầng)|layout|mặt\s*bằng)", 5, "Hỏi thông số căn hộ"),
    ("RESEARCH", r"(tiện\s*(ích|nghi)|hồ\s*bơi|gym|trường\s*học|bệnh\s*viện|siêu\s*thị)", 4, "Hỏi tiện ích"),
    ("RESEARCH", r"(vị\s*trí|gần\s*(đâu|trung\s*tâm|quận)|khoảng\s*cách|đường\s*nào)", 4, "Hỏi vị trí"),
    ("RESEARCH", r"(view\s*(sông|biển|thành\s*phố|hồ)|tầng\s*(cao|thấp|mấy))", 4, "Hỏi view/tầng"),
    ("RESEARCH", r"(nội\s*thất|bàn\s*giao\s*nội\s*thất|full\s*nội\s*thất|đầy\s*đủ\s*nội\s*thất)", 5, "Hỏi nội thất"),
    ("RESEARCH", r"(dân\s*cư|cộng\s*đồng|hàng\s*xóm|môi\s*trường\s*sống)", 3, "Hỏi cộng đồng"),
    ("RESEARCH", r"(gửi\s*(thông\s*tin|brochure|file|catalog|link|tài\s*liệu))", 5, "Yêu cầu tài liệu"),
    ("CONCERN", r"(đắt\s*(quá|lắm|vậy)|giá\s*(cao|đắt)\s*quá)", -4, "Phàn nàn giá đắt"),
    ("CONCERN", r"(không\s*(phù\s*hợp|quan\s*tâm|thích|hợp))", -5, "Không quan tâm"),
    ("CONCERN", r"(thôi|bỏ|hủy|không\s*cần\s*nữa|không\s*mua\s*nữa)", -7, "Hủy quan tâm"),
    ("CONCERN", r"(chờ\s*(thêm|xem|đã)|suy\s*nghĩ\s*thêm|cần\s*thêm\s*thời\s*gian)", -2, "Cần thêm thời gian"),
    ("CONCERN", r"(lo\s*(ngại|lắng)|e\s*ngại|lo\s*sợ|không\s*chắc)", -3, "Lo ngại"),
    ("CONCERN", r"(so\s*với\s*dự\s*án\s*(khác|bên\s*kia)\s*(rẻ|tốt|đẹp|hơn))", -3, "So sánh bất lợi"),
    ("CONCERN", r"(vợ\s*(chưa|không)\s*(đồng\s*ý|cho|chịu)|chồng\s*(chưa|không)\s*đồng\s*ý)", -2, "Cần ý kiến gia đình"),
]
# (lower bound of the composite, level, colour, probability)
INTENT_LEVELS = [(8.0, "Rất cao", "#3fb950", "85-95%"), (6.5, "Cao", "#39d353", "65-80%"),
                 (4.5, "Trung bình", "#d29922", "35-55%"), (2.5, "Thấp", "#f97316", "15-30%"),
                 (None, "Rất thấp", "#f85149", "<15%")]
NEXT_ACTIONS = {
    "call_now": ("Gọi điện xác nhận ngay", "Ngay"),
    "call_24h": ("Gọi trong 24h tiếp theo", "Trong 24h"),
    "send_finance": ("Gửi thông tin vay/thanh toán", "Trong tuần"),
    "handle_concern": ("Xử lý phản đối trước khi follow up", "Trong tuần"),
    "nurture": ("Nuture qua content phù hợp", "Nuture"),
}
STAGES = {"closing": "Sẵn sàng chốt", "evaluating": "Đánh giá & cân nhắc",
          "collecting": "Thu thập thông tin", "opening": "Khởi đầu / Làm quen"}
PROGRESSION = {"short": "Chưa đủ dữ liệu", "up": "Tăng dần →", "down": "Giảm dần ↓",
               "flat": "Ổn định →"}
RESPONSE_SPEED = [(5, "🟢 Rất nhanh (<5 phút)"), (30, "🟡 Nhanh (<30 phút)"),
                  (120, "🟠 Bình thường (<2 giờ)"), (None, "🔴 Chậm (>2 giờ)")]
RESPONSE_UNKNOWN = "Không đủ dữ liệu"
EMPTY_CHAT = {"stage": "Chưa có dữ liệu", "progression": "—", "response_speed": "—",
              "probability": "<5%", "next_action": "Thu thập tin nhắn từ Messenger",
              "summary": "Không có đủ dữ liệu để phân tích."}

# --- fixed values: 360 profile ---------------------------------------------
PROFILE_CLUSTERS = {2: ("VIP", "P0"), 1: ("Ở thực", "P1"), 0: ("Đầu cơ", "P2")}
PROFILE_UNCLUSTERED = ("Chưa phân", "P3")
PROFILE_PROBABILITY = [(8, "Rất cao", "85-95%"), (6, "Cao", "60-80%"),
                       (4, "Trung bình", "35-55%"), (2, "Thấp", "15-30%"),
                       (0, "Rất thấp", "<15%")]
