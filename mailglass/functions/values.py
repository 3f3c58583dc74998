"""Fixed values that results depend on: rule ids with points, term lists, thresholds. Stated plainly."""

from __future__ import annotations

#: The rules in evaluation order, (id, points).
RULES = (
    ("att_double_ext", 10), ("att_ext_high_risk", 12), ("att_ext_medium_risk", 8), ("att_ext_low_risk", 3), ("att_html", 4),
    ("att_random_name", 5), ("att_type_mismatch", 12), ("att_mime_type_conflict", 10), ("att_generic_mime", 3), ("att_filename_bidi", 10),
    ("att_filename_overlong", 3), ("att_filename_space_padding", 3), ("att_archive_password_in_body", 12), ("att_archive_inner_executable", 10), ("att_archive_encrypted", 8),
    ("att_archive_inner_macro", 6), ("att_archive_nested", 3), ("att_office_remote_template", 12), ("att_office_dde", 10), ("att_office_macro_download", 10),
    ("att_office_macro_shell", 8), ("att_office_macro_autoexec", 8), ("att_office_macro", 8), ("att_office_macro_obfuscated", 6), ("att_pdf_javascript", 10),
    ("att_pdf_launch", 10), ("att_pdf_embedded", 6), ("att_name_no_ext_media", 6), ("att_yara_hit", 12), ("html_password_field", 8),
    ("anchor_text_mismatch", 8), ("body_urgency", 5), ("body_credentials", 7), ("body_credential_solicitation", 7), ("body_bec_payment", 4),
    ("hidden_html_brand_mismatch", 8), ("hidden_html_bulk", 5), ("html_comment_split_base64", 8), ("body_otp", 5), ("body_reward_lure", 5),
    ("subject_suspicious", 2), ("subject_shouting", 3), ("body_credentials_no_link", 3), ("image_heavy_body", 4), ("body_brand_spoof", 8),
    ("lure_attachment_pattern", 3), ("subject_subsidy_lure", 5), ("body_subsidy_lure", 5), ("subject_subsidy_lure_obfuscated", 5), ("subject_academic_solicitation", 4),
    ("body_academic_solicitation", 3), ("body_gift_marketing", 5), ("body_mail_system_lure", 8), ("subject_cjk_noise", 3), ("body_unsubscribe_link", 1),
    ("subject_image_bait", 5), ("subject_freight_spam", 6), ("image_only_body", 8), ("html_file_uri", 6), ("html_massmailer_fingerprint", 10),
    ("header_reply_mismatch", 3), ("header_return_path_mismatch", 6), ("header_missing_auth", 2), ("header_auth_inconsistent", 6), ("signal_stack", 12),
    ("header_list_unsubscribe", 1), ("header_precedence_bulk", 1), ("xmailer_random_junk", 4), ("auth_smtp_mail_mismatch", 6), ("link_domain_lookalike", 10),
    ("link_domain_mismatch", 4), ("link_user_content_hosting", 6), ("text_invisible_obfuscation", 6), ("from_header_multi_address", 4), ("from_localpart_numeric_noise", 4),
    ("from_display_brand_spoof", 8), ("from_display_email_mismatch", 8), ("domain_leet_brand", 8), ("reply_to_freemail", 6), ("sender_from_freemail", 2),
    ("display_name_all_caps", 3), ("display_name_decoration", 3), ("sender_esp_domain", 1), ("url_ip_literal", 8), ("url_suspicious_tld", 5),
    ("url_punycode", 8), ("url_shortener", 5), ("url_at_sign", 6), ("url_many_subdomains", 4), ("url_keywords", 5),
)

#: Rule groups.
STRONG = (
    "html_password_field", "att_double_ext", "att_ext_high_risk", "att_ext_medium_risk", "att_archive_password_in_body", "att_archive_inner_executable",
    "att_office_remote_template", "att_office_dde", "att_office_macro_download", "att_office_macro_shell", "att_pdf_launch", "html_massmailer_fingerprint",
    "att_yara_hit", "body_credential_solicitation", "body_credentials_no_link", "url_ip_literal", "from_display_brand_spoof", "domain_leet_brand",
    "link_domain_lookalike", "text_invisible_obfuscation", "header_auth_inconsistent",
)
MARKETING = ("header_list_unsubscribe", "header_precedence_bulk", "body_unsubscribe_link", "sender_esp_domain", "body_gift_marketing")
STACK_NOISE = ("header_missing_auth", "header_list_unsubscribe", "header_precedence_bulk", "body_unsubscribe_link", "sender_esp_domain", "sender_from_freemail")
STRUCTURAL_DEMOTE = ("header_list_unsubscribe", "header_precedence_bulk", "body_unsubscribe_link", "sender_esp_domain", "sender_from_freemail", "from_localpart_numeric_noise")
WORDING_DEMOTE = ("body_credentials", "body_urgency", "body_otp", "body_brand_spoof")

#: Term lists.
EXT_HIGH = tuple("exe scr com pif dll cpl sys ocx hta lnk iso img vhd msi".split())
EXT_MEDIUM = tuple("js jse vbs vbe wsf wsh ps1 bat cmd jar apk chm reg docm xlsm pptm dotm xlam xlsb".split())
EXT_LOW = tuple("zip rar 7z cab ace arj lzh tar gz bz2 xz z".split())
SHORTENERS = tuple("bit.ly t.co tinyurl.com goo.gl is.gd ow.ly buff.ly rebrand.ly cutt.ly shorturl.at rb.gy t.ly s.id t.cn url.cn dwz.cn suo.im".split())
SUSPICIOUS_TLDS = tuple("zip mov top xyz tk ml ga cf gq ru click link work rest country kim loan skin biz".split())
FREEMAIL = tuple("gmail.com outlook.com hotmail.com yahoo.com aol.com icloud.com 163.com 126.com qq.com sina.com sohu.com mail.ru yandex.com proton.me gmx.com live.com foxmail.com 139.com yeah.net 188.com 21cn.com".split())
TWO_LEVEL = tuple(
    "co.uk org.uk ac.uk gov.uk me.uk net.uk sch.uk co.jp or.jp ne.jp ac.jp go.jp com.br net.br org.br com.au net.au org.au edu.au co.nz net.nz org.nz co.za org.za com.cn net.cn edu.cn org.cn gov.cn ac.cn mil.cn com.tw com.hk org.hk edu.hk gov.hk idv.hk co.kr or.kr com.mx com.ar com.tr com.sg com.my co.in net.in org.in com.pl com.ua co.id com.vn com.ph com.co com.pe".split()
)
URL_KEYWORDS = tuple("login signin verify secure account update password confirm billing invoice wallet recover unlock 登录 验证 密码 账户 重置".split())
#: Own list: phrases that ask for credentials.
CREDENTIAL_KEYWORDS = ("verify your identity", "submit your details", "enter your password", "confirm your password", "re-enter your credentials")

#: Scoring.
HEURISTIC_CAP, AUTH_CAP, OFFLINE_MAX, MALICIOUS_AT, SUSPICIOUS_AT = 30, 12, 45, 55, 30
INTEL_FLOOR, INTEL_WEIGHT = 60, 0.55
REPUTATION_TIERS = ((20, 90), (10, 78), (5, 60), (3, 44), (2, 30), (1, 18))
STACK_TIERS = ((6, 12), (5, 8), (4, 4))

#: File types by their first bytes (hexadecimal), in order of test.
SIGNATURES = (
    ("pe", "4D5A"), ("zip", "504B0304"), ("zip", "504B0506"), ("ole2", "D0CF11E0A1B11AE1"), ("pdf", "25504446"), ("rar", "526172211A07"), ("sevenzip", "377ABCAF271C"),
    ("lnk", "4C00000001140200"), ("gzip", "1F8B"), ("rtf", "7B5C727466"), ("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "47494638"),
)
#: The extensions that go with a type.
TYPE_EXTENSIONS = {
    "pe": "exe dll scr com pif sys ocx cpl", "zip": "zip docx xlsx pptx odt ods odp odg jar apk epub xpi kmz vsdx xlsb docm xlsm pptm",
    "ole2": "doc xls ppt msg vsd msi mdb pub dot xlt pot docm xlsm pptm", "pdf": "pdf", "rar": "rar", "sevenzip": "7z", "lnk": "lnk", "iso": "iso img udf", "gzip": "gz tgz",
    "rtf": "rtf doc", "jpeg": "jpg jpeg jpe", "png": "png", "gif": "gif", "text": "txt csv log md json xml ini conf bat ps1 vbs js html htm eml yaml yml srt vcf", "html": "html htm xhtml",
}
WEAK_TYPES = ("text", "html", "unknown")
#: The type that a declared content type stands for.
MIME_TYPES = {
    "application/pdf": "pdf", "application/x-dosexec": "pe", "application/x-msdownload": "pe", "application/x-msdos-program": "pe", "application/vnd.microsoft.portable-executable": "pe",
    "application/zip": "zip", "application/x-zip-compressed": "zip",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "zip", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "zip",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "zip", "application/vnd.oasis.opendocument.text": "zip", "application/java-archive": "zip", "application/vnd.android.package-archive": "zip",
    "application/msword": "ole2", "application/vnd.ms-excel": "ole2", "application/vnd.ms-powerpoint": "ole2", "application/vnd.ms-outlook": "ole2", "application/vnd.ms-installer": "ole2", "application/x-ole-storage": "ole2", "application/x-msi": "ole2",
    "application/x-rar-compressed": "rar", "application/vnd.rar": "rar", "application/x-7z-compressed": "sevenzip", "application/x-iso9660-image": "iso", "application/gzip": "gzip", "application/x-gzip": "gzip", "application/rtf": "rtf", "text/rtf": "rtf",
    "image/jpeg": "jpeg", "image/png": "png", "image/gif": "gif", "text/html": "html",
}
GENERIC_MIMES = ("", "application/octet-stream", "application/binary", "binary/octet-stream", "application/force-download", "application/download", "application/unknown")
#: Limits of archive inspection.
ARCHIVE_DEPTH, ARCHIVE_ENTRIES, ARCHIVE_TOTAL, ARCHIVE_SINGLE = 3, 200, 50 << 20, 20 << 20
INNER_EXECUTABLE = tuple("exe scr com pif dll cpl sys ocx hta lnk msi vhd js jse vbs vbe wsf wsh ps1 bat cmd jar apk chm reg".split())
INNER_MACRO = tuple("docm xlsm pptm dotm xlam xlsb".split())

#: Letters that look like Latin ones.
HOMOGLYPHS = ("аеорсухкмнтвіѕАВСЕНКМОРТХІЅαοενρτ", "aeopcyxkmhtbisABCEHKMOPTXISaoevpt")

#: Patterns of macro findings.
MACRO_PATTERNS = {
    "autoexec": r"\b(?:AutoOpen|Auto_Open|AutoExec|AutoClose|Auto_Close|Document_Open|Document_Close|DocumentBeforeClose|Workbook_Open|Workbook_BeforeClose|Workbook_Activate|AutoNew)\b",
    "shell": r"\b(?:Shell|ShellExecute|WScript\.Shell|CreateObject|cmd\.exe|powershell|WinExec|CallByName)\b",
    "download": r"\b(?:URLDownloadToFile|XMLHTTP|MSXML2|ServerXMLHTTP|ADODB\.Stream|WinHttp|InternetOpenUrl|FollowHyperlink|DownloadFile|GetObject)\b",
    "obfuscated": r"\bStrReverse\b|\bChrW?\s*\(|Base64|FromBase64String",
}

#: Office documents by extension, and how they load templates and run commands.
OFFICE_EXTENSIONS = tuple("docx docm xlsx xlsm pptx pptm dotm xlam xlsb odt ods doc xls ppt msi msg vsd pub".split())
REMOTE_TARGET = r'Target="(https?://[^"\s]+)"'
DDE_FIELD = r"DDEAUTO|{\s*DDE"
#: How a text states an archive's password, and how much of each body is read for it.
PASSWORD_PATTERNS = (
    r"(?U)(?:密码|解压码|提取码|解压密码|口令)\s*(?:是|为|[:：=])?\s*([A-Za-z0-9@#$%^&*_\-+.]{3,32})",
    r"(?iuU)(?:password|passcode|passwd|pwd)\s*(?:is|[:：=])?\s*([A-Za-z0-9@#$%^&*_\-+.]{3,32})",
)
PASSWORD_TEXT = 200_000
#: Content families with their severity, and what they look for.
FAMILIES = {"Phish_Credential_Keywords": "medium", "Phish_HTML_Login_Page": "high", "Malware_Macro_Office_Document": "high", "Phish_Obfuscated_URL_Tactics": "medium"}
FAMILY_PATTERNS = {
    "urgent": r"(?i)urgent|immediately|within\s+24\s+hours|action\s+required", "asks": r"(?i)verify\s+your\s+(account|identity)|confirm\s+your\s+password|update\s+your\s+billing",
    "form": r"(?is)<form[^>]*(action|method)", "password": r"""(?i)<input[^>]*type=["']?password""", "page": r"(?i)<(!doctype\s+)?html", "submit": r"(?i)login|sign\s?in|verify|confirm",
    "opens": r"Auto_?Open|Document_Open|Workbook_Open|Auto_?Close", "shell": r"(?i)Shell|CreateObject|WScript\.Shell|cmd\.exe|powershell",
    "hxxp": r"(?i)hxxps?://", "user": r"(?i)https?://[^\s/]+@[^\s/]+", "ip": r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
}
ZH_URGENT, ZH_ASKS = ("紧急", "立即", "冻结"), ("验证账号", "输入密码", "重置密码")
#: Signals that no trust ever lowers, and how far trust lowers those of wording.
NEVER_DEMOTE = (
    "url_ip_literal", "link_domain_lookalike", "from_display_brand_spoof", "from_display_email_mismatch", "domain_leet_brand", "att_double_ext", "att_ext_high_risk", "att_ext_medium_risk", "att_type_mismatch", "att_yara_hit",
    "att_office_remote_template", "att_office_dde", "att_office_macro_download", "att_office_macro_shell", "att_pdf_launch", "att_archive_inner_executable", "att_archive_password_in_body", "html_password_field", "html_file_uri",
    "html_massmailer_fingerprint", "body_credential_solicitation", "body_credentials_no_link",
)
WORDING_FACTOR = 0.3
