"""Enumerations, labels, aliases and field hints.

Everything in this file is a fixed value that results depend on; nothing here is logic.
"""

# --- enumerations -----------------------------------------------------------------------------
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
ADVISORY_STATUSES = (
    "UPLOADED", "EXTRACTING", "EXTRACTED", "NEEDS_CVE_UPDATE",
    "MATCHED", "NOTIFYING", "COMPLETED", "ARCHIVED",
)
RECEIVE_CHANNELS = ("NCST", "WEBMAIL", "OFFICIAL_DOC")
ACK_STATUSES = ("NONE", "IN_PROGRESS", "DONE", "UNABLE")
SLA_STATUSES = ("NORMAL", "IMMINENT", "OVERDUE", "DONE")

CLOSED_ACKS = ("DONE", "UNABLE")
OPEN_ACKS = ("NONE", "IN_PROGRESS")
DELIVERED = ("SENT", "ACKED")
# Advisories whose remediation is being tracked (deadline overview and reminders).
TRACKED_STATUSES = ("NOTIFYING", "MATCHED", "COMPLETED")
FINISHED_STATUSES = ("COMPLETED", "ARCHIVED")
IN_PROGRESS_STATUSES = (
    "UPLOADED", "EXTRACTING", "EXTRACTED", "NEEDS_CVE_UPDATE", "MATCHED", "NOTIFYING",
)
DEFAULT_CHANNELS = ("MAIL", "WEB_UI")

# --- labels -----------------------------------------------------------------------------------
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SEVERITY_KO = {"CRITICAL": "긴급", "HIGH": "높음", "MEDIUM": "중간", "LOW": "낮음"}
ACK_KO = {"NONE": "미회신", "IN_PROGRESS": "진행중", "DONE": "조치완료", "UNABLE": "조치불가"}
SLA_KO = {"NORMAL": "정상", "IMMINENT": "임박", "OVERDUE": "기한초과", "DONE": "완료"}
ACTION_KO = {
    "ADVISORY_UPLOAD": "권고문 업로드",
    "ADVISORY_EXTRACT": "CVE 추출",
    "ADVISORY_MATCH": "자산 매칭",
    "MATCH_EXCLUDE": "오탐 제외",
    "CVE_ADD_MANUAL": "CVE 수동 추가",
    "CVE_DELETE_MANUAL": "CVE 삭제",
    "CVE_FEED_VALIDATE": "CVE 피드 검증",
    "CVE_FEED_APPLY": "CVE 피드 적용",
    "ASSET_IMPORT_COMMIT": "자산대장 가져오기",
    "NOTIFY_SEND": "권고 발송",
    "NOTIFY_ACK": "조치 회신",
    "NOTIFY_EVIDENCE": "증빙 등록",
    "NOTIFY_REMIND": "미회신 리마인드",
    "BOARD_POST": "게시판 게시",
}
# Texts a department may reply with on the message board.
ACK_REPLY_ALIASES = {
    "완료": "DONE", "조치완료": "DONE", "진행중": "IN_PROGRESS", "불가": "UNABLE", "조치불가": "UNABLE",
}
AUTO_DEPLOY_OWNER = "자동배포"
SYSTEM_LABEL = "시스템"
MANUAL_SNIPPET = "(수동 추가)"
NO_DEPARTMENT = "(부서 미지정)"

# --- code pattern -----------------------------------------------------------------------------
# Identifier with dash, underscore or blank separators; year in group 1, serial in group 2.
CVE_PATTERN = r"(?iU)CVE[\s\-_]*(\d{4})[\s\-_]+(\d{4,7})"
SNIPPET_CONTEXT = 50

# --- product aliases: canonical product key -> lower-case substrings -----------------------------
PRODUCT_ALIASES = {
    "windows_11": ["windows 11", "win11", "win 11", "windows11", "window 11"],
    "windows_10": ["windows 10", "win10", "win 10", "windows10", "window 10"],
    "windows_server": ["windows server", "win server", "winsrv", "windows srv"],
    "microsoft_office": ["microsoft office", "ms office", "office", "msoffice", "오피스"],
    "google_chrome": ["google chrome", "chrome", "크롬"],
    "hancom_office": ["한컴오피스", "한컴 오피스", "hancom office", "hancom", "hwp", "한글"],
    "adobe_acrobat": ["adobe acrobat", "acrobat reader", "acrobat", "adobe reader", "어도비 아크로뱃"],
    "edge": ["microsoft edge", "msedge", "edge", "엣지"],
    "linux_kernel": ["linux kernel", "리눅스 커널", "linux"],
    "ubuntu": ["ubuntu", "우분투"],
    "ibm_aix": ["aix"],
    "openssl": ["openssl"],
    "apache_httpd": ["apache httpd", "apache http server", "httpd", "apache"],
    "nginx": ["nginx"],
}

# --- CSV feed headers -> canonical column ---------------------------------------------------------
CSV_HEADER_ALIASES = {
    "cve": "cve_id", "cve_id": "cve_id", "cveid": "cve_id",
    "product": "product", "제품": "product", "제품명": "product", "os": "product",
    "versions": "versions", "version": "versions", "버전": "versions", "영향버전": "versions",
    "severity": "severity", "심각도": "severity", "등급": "severity",
    "cvss": "cvss", "cvss_score": "cvss", "점수": "cvss",
    "description": "description", "desc": "description", "설명": "description",
    "published": "published", "게시일": "published", "발표일": "published",
    "source": "source", "출처": "source",
}

# --- asset ledger: field -> header hints (lower case, substring), in assignment order --------------
LEDGER_FIELD_HINTS = {
    "asset_no": ["자산번호", "자산no", "자산 번호", "asset", "관리번호", "번호"],
    "department": ["부서", "사용부서", "담당부서", "dept", "department"],
    "product_key": ["운영체제", "os", "제품", "sw", "소프트웨어", "product", "프로그램"],
    "version_norm": ["버전", "version", "세부버전", "ver"],
    "ip": ["ip", "아이피", "주소"],
    "owner_name": ["담당자", "사용자", "owner", "담당", "이름"],
    "owner_team": ["담당팀", "소속팀", "소속"],
    "owner_contact": ["연락처", "전화", "휴대폰", "핸드폰", "전화번호", "contact", "phone", "tel"],
}
HEADER_SCAN_ROWS = 15

# --- limits ---------------------------------------------------------------------------------------
MAX_UPLOAD_BYTES = 30 * 1024 * 1024
MAX_AUDIT_PAGE = 200
IMMINENT_DAYS = 3
MAX_STALE_DAYS = 7

# Characters that a whitespace strip removes (Unicode white space plus the ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
