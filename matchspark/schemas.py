"""Logical schemas and enum domains of the entity tables."""

from __future__ import annotations

# Enum domains of the entity schema.
ENUMS: dict[str, tuple[str, ...]] = {
    "Gender": ("MALE", "FEMALE", "OTHER"),
    "UserRole": ("CANDIDATE", "RECRUITER", "ADMIN"),
    "SkillLevel": ("BEGINNER", "INTERMEDIATE", "ADVANCED", "EXPERT"),
    "LanguageLevel": ("BASIC", "INTERMEDIATE", "ADVANCED", "NATIVE"),
    "ExperienceLevel": ("INTERN", "FRESHER", "JUNIOR", "MIDDLE", "SENIOR", "LEAD", "MANAGER"),
    "JobType": ("FULL_TIME", "PART_TIME", "CONTRACT", "INTERNSHIP", "FREELANCE"),
    "CompanySize": ("STARTUP", "SMALL", "MEDIUM", "LARGE", "ENTERPRISE"),
    "AppStatus": ("PENDING", "REVIEWING", "ACCEPTED", "REJECTED", "CANCELLED"),
    "NotificationType": (
        "APPLICATION_RECEIVED", "APPLICATION_STATUS_CHANGED", "COMPANY_REGISTRATION",
        "COMPANY_APPROVED", "COMPANY_REJECTED", "COMPANY_UPDATE_PENDING", "COMPANY_INVITATION",
        "INVITATION_REJECTED", "MEMBER_JOINED", "MEMBER_REMOVED", "JOB_POSTED", "JOB_APPROVED",
        "JOB_REJECTED", "JOB_UPDATE_PENDING", "WELCOME",
    ),
    "Status": ("DRAFT", "ACTIVE", "INACTIVE", "LOCKED", "PENDING", "SUSPENDED"),
    "CompanyRole": ("OWNER", "MANAGER", "RECRUITER", "VIEWER"),
    "InvitationStatus": ("PENDING", "ACCEPTED", "REJECTED", "CANCELLED", "EXPIRED"),
}
