"""Enum lookup tables of the ingest step (must equal the source system's)."""

from __future__ import annotations

# Fixed values.
GENDER_MAP = {
    "nam": "MALE",
    "nữ": "FEMALE",
    "khác": "OTHER",
    "male": "MALE",
    "female": "FEMALE",
    "other": "OTHER",
}

# Fixed values.
EXPERIENCE_LEVEL_MAP = {
    "thực tập sinh": "INTERN",
    "intern": "INTERN",
    "fresher": "FRESHER",
    "nhân viên": "JUNIOR",
    "junior": "JUNIOR",
    "middle": "MIDDLE",
    "senior": "SENIOR",
    "trưởng nhóm": "LEAD",
    "lead": "LEAD",
    "quản lý": "MANAGER",
    "manager": "MANAGER",
    "không yêu cầu kinh nghiệm": "FRESHER",
    "chưa có kinh nghiệm": "FRESHER",
    "dưới 1 năm": "FRESHER",
    "1-3 năm": "JUNIOR",
    "3-5 năm": "MIDDLE",
    "5-10 năm": "SENIOR",
    "trên 10 năm": "LEAD",
}

# Fixed values.
JOB_TYPE_MAP = {
    "full time": "FULL_TIME",
    "full-time": "FULL_TIME",
    "toàn thời gian": "FULL_TIME",
    "part time": "PART_TIME",
    "part-time": "PART_TIME",
    "bán thời gian": "PART_TIME",
    "contract": "CONTRACT",
    "hợp đồng": "CONTRACT",
    "internship": "INTERNSHIP",
    "thực tập": "INTERNSHIP",
    "freelance": "FREELANCE",
}

# Company size, first key contained in the text wins (in this order).
COMPANY_SIZE_ORDER = [
    ("1-9", "STARTUP"),
    ("10-24", "SMALL"),
    ("25-99", "SMALL"),
    ("100-499", "MEDIUM"),
    ("500-999", "LARGE"),
    ("1000+", "ENTERPRISE"),
    ("trên 1000", "ENTERPRISE"),
]

# Labels of the CV summary parts and default texts.
SUMMARY_LABELS = ("Ngành: ", "Nơi làm việc: ", "Mức lương mong muốn: ")
UNTITLED = "Untitled"
DESCRIPTION_PREFIX = "Mô tả công việc: "
CV_TITLE_PREFIX = "CV của "
UNKNOWN_COMPANY = "Unknown Company"
