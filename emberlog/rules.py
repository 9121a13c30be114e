"""Event groups, phases, mechanisms, threat groups, weights and texts of the rules."""

from __future__ import annotations

# Which API calls matter, by investigative purpose.
EVENT_GROUPS: dict[str, tuple[str, ...]] = {
    "authentication": ("ConsoleLogin", "GetSessionToken", "GetFederationToken", "AssumeRole", "AssumeRoleWithSAML", "AssumeRoleWithWebIdentity", "GetCallerIdentity"),
    "identity_mutation": (
        "CreateUser", "DeleteUser", "CreateAccessKey", "DeleteAccessKey", "UpdateAccessKey", "CreateLoginProfile", "UpdateLoginProfile",
        "AttachUserPolicy", "DetachUserPolicy", "PutUserPolicy", "AttachRolePolicy", "DetachRolePolicy", "PutRolePolicy", "AttachGroupPolicy",
        "PutGroupPolicy", "AddUserToGroup", "CreateRole", "DeleteRole", "UpdateAssumeRolePolicy", "CreatePolicy", "CreatePolicyVersion",
        "SetDefaultPolicyVersion", "CreateServiceLinkedRole", "PassRole", "DeactivateMFADevice", "DeleteVirtualMFADevice",
    ),
    "discovery": (
        "ListUsers", "ListRoles", "ListPolicies", "ListAccessKeys", "ListAttachedUserPolicies", "ListAttachedRolePolicies", "GetAccountAuthorizationDetails",
        "ListBuckets", "DescribeInstances", "ListFunctions", "DescribeDBInstances", "ListSecrets", "GetAccountSummary", "ListGroupsForUser",
    ),
    "defense_evasion": (
        "StopLogging", "DeleteTrail", "UpdateTrail", "PutEventSelectors", "DeleteDetector", "UpdateDetector", "DisassociateFromMasterAccount",
        "DeleteFlowLogs", "StopConfigurationRecorder", "DeleteConfigurationRecorder", "PutRetentionPolicy", "DeleteLogGroup", "DeleteLogStream",
        "DisableSecurityHub", "DeleteAlarms", "DisableAlarmActions",
    ),
    "data_access": (
        "GetObject", "ListObjects", "ListObjectsV2", "CopyObject", "PutObject", "DeleteObject", "GetBucketAcl", "PutBucketAcl", "PutBucketPolicy",
        "GetSecretValue", "Decrypt", "CreateDBSnapshot", "ModifyDBSnapshotAttribute", "CreateSnapshot", "ModifySnapshotAttribute", "SharedSnapshotCopy",
    ),
    "persistence": (
        "CreateFunction", "UpdateFunctionCode", "UpdateFunctionConfiguration", "AddPermission", "CreateEventSourceMapping", "PutRule", "PutTargets",
        "RunInstances", "CreateKeyPair", "ImportKeyPair", "CreateStack", "UpdateStack", "SendCommand", "StartSession", "CreateAccessEntry", "RegisterTaskDefinition",
    ),
    "resource_exposure": (
        "AuthorizeSecurityGroupIngress", "ModifyImageAttribute", "ModifyDBClusterSnapshotAttribute", "PutResourcePolicy", "AddLayerVersionPermission",
        "ModifyVpcEndpointServicePermissions",
    ),
}
DEFAULT_GROUPS = tuple(EVENT_GROUPS)
CRITICAL_EVENTS = EVENT_GROUPS["defense_evasion"] + (
    "CreateAccessKey", "AttachUserPolicy", "PutUserPolicy", "CreateUser", "AttachRolePolicy", "UpdateAssumeRolePolicy", "ConsoleLogin", "AssumeRole",
    "CreatePolicyVersion", "SetDefaultPolicyVersion", "PassRole", "DeactivateMFADevice",
)

# Roles of events in correlation.
DISABLE = ("StopLogging", "DeleteTrail", "DeleteFlowLogs", "StopConfigurationRecorder", "DeleteConfigurationRecorder", "DeleteDetector", "DisableSecurityHub")
ENABLE = ("StartLogging", "CreateTrail", "CreateFlowLogs", "StartConfigurationRecorder", "CreateDetector", "EnableSecurityHub")
ESCALATION = (
    "CreateAccessKey", "AttachUserPolicy", "PutUserPolicy", "AttachRolePolicy", "PutRolePolicy", "CreateLoginProfile", "UpdateAssumeRolePolicy",
    "CreatePolicyVersion", "SetDefaultPolicyVersion", "CreateUser", "AddUserToGroup",
)
ACCESS = ("ConsoleLogin", "AssumeRole", "GetSessionToken", "GetFederationToken", "GetCallerIdentity")
EXFILTRATION = ("GetObject", "CopyObject", "PutObject", "CreateDBSnapshot", "ModifySnapshotAttribute", "ModifyDBSnapshotAttribute", "SharedSnapshotCopy", "ModifyImageAttribute")
LISTING = ("ListUsers", "ListRoles", "ListBuckets", "DescribeInstances")
MINTING = ("AssumeRole", "AssumeRoleWithSAML", "AssumeRoleWithWebIdentity")
PHASES: dict[str, tuple[str, ...]] = {
    "initial_access": ACCESS,
    "privilege_escalation": ESCALATION,
    "defense_evasion": DISABLE,
    "collection_exfiltration": EXFILTRATION,
    "discovery": LISTING,
}
#: Names that correlation and the persistence rules need and that no group has.
LOGGING_RESTORE = ENABLE
CORRELATED_ONLY = (
    "DeleteObjects", "PutBucketLifecycle", "PutBucketLifecycleConfiguration", "PutBucketVersioning", "DeleteBucketPolicy", "BatchGetSecretValue",
    "GetParameter", "GetParameters", "GetParametersByPath", "PutObjectAcl", "ModifyDBInstance", "ModifyInstanceAttribute", "CreateDocument",
    "UpdateDocument", "CreateAssociation", "CreateSAMLProvider", "UpdateSAMLProvider", "CreateOpenIDConnectProvider",
)



def technique_url(technique: str) -> str:
    """The page of a technique in the public catalog of cloud techniques."""
    return f"https://aws-samples.github.io/threat-technique-catalog-for-aws/Techniques/{technique}.html"


# Persistence mechanisms (events, technique, name, severity, text).
MECHANISMS: dict[str, tuple[tuple[str, ...], str, str, str, str]] = {
    "iam_backdoor": (("CreateUser", "CreateAccessKey", "CreateLoginProfile", "AttachUserPolicy", "PutUserPolicy", "AddUserToGroup"), "T1136.003", "Create Account: Cloud Account", "high", "establishes or extends an IAM identity"),
    "role_trust_modification": (("UpdateAssumeRolePolicy", "CreateRole"), "T1098.003", "Account Manipulation: Additional Cloud Roles", "critical", "changes who can assume a role"),
    "policy_backdoor": (("CreatePolicyVersion", "SetDefaultPolicyVersion", "AttachRolePolicy", "PutRolePolicy"), "T1098.003", "Account Manipulation: Additional Cloud Roles", "high", "alters effective permissions"),
    "lambda_persistence": (("CreateFunction", "UpdateFunctionCode", "UpdateFunctionConfiguration", "AddPermission", "CreateEventSourceMapping"), "T1546", "Event Triggered Execution", "high", "creates or modifies code with a trigger"),
    "eventbridge_persistence": (("PutRule", "PutTargets"), "T1546", "Event Triggered Execution", "medium", "wires an event to a target"),
    "compute_persistence": (("RunInstances", "CreateKeyPair", "ImportKeyPair", "ModifyInstanceAttribute"), "T1578", "Modify Cloud Compute Infrastructure", "medium", "establishes attacker-controlled compute"),
    "ssm_persistence": (("CreateDocument", "UpdateDocument", "CreateAssociation", "SendCommand"), "T1651", "Cloud Administration Command", "high", "enables remote execution on managed instances"),
    "identity_provider": (("CreateSAMLProvider", "UpdateSAMLProvider", "CreateOpenIDConnectProvider"), "T1556", "Modify Authentication Process", "critical", "alters federation trust"),
    "mfa_removal": (("DeactivateMFADevice", "DeleteVirtualMFADevice"), "T1556.006", "Modify Authentication Process: Multi-Factor Authentication", "critical", "weakens authentication on an identity"),
}
AUTOMATION_HINTS = ("cloudformation", "terraform", "pulumi", "cdk", "ci-", "cicd", "deploy", "pipeline", "github-actions", "jenkins")
SEVERITIES = ("critical", "high", "medium", "low")

# ATT&CK groups (id, name, tier, aliases), in order of precedence.
THREAT_GROUPS: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("G0016", "APT29", "state", ("APT29", "Cozy Bear", "Midnight Blizzard", "Nobelium", "The Dukes", "UNC2452")),
    ("G0007", "APT28", "state", ("APT28", "Fancy Bear", "Forest Blizzard", "Sofacy", "Sednit", "STRONTIUM")),
    ("G0032", "Lazarus Group", "state", ("Lazarus", "Lazarus Group", "Hidden Cobra", "Diamond Sleet", "ZINC")),
    ("G0065", "Leviathan", "state", ("APT40", "Leviathan", "Gingham Typhoon", "TEMP.Periscope")),
    ("G0010", "Turla", "state", ("Turla", "Secret Blizzard", "Venomous Bear", "Waterbug")),
    ("G0139", "TeamTNT", "criminal", ("TeamTNT",)),
    ("G0122", "Silent Librarian", "criminal", ("Silent Librarian", "COBALT DICKENS")),
    ("G1015", "Scattered Spider", "criminal", ("Scattered Spider", "Octo Tempest", "UNC3944", "Muddled Libra")),
    ("G0102", "Wizard Spider", "criminal", ("Wizard Spider", "TrickBot Group", "UNC1878")),
)

# Indicators.
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:com|net|org|io|ru|cn|info|biz|top|xyz|club|online|site|tk|ml|ga|cf|gq|su|pw)\b"
MD5 = r"\b[a-fA-F0-9]{32}\b"
SHA256 = r"\b[a-fA-F0-9]{64}\b"
DOMAIN_DENYLIST = ("amazonaws.com", "aws.amazon.com", "console.aws.amazon.com", "signin.aws.amazon.com", "s3.amazonaws.com", "cloudfront.net", "amazon.com", "microsoft.com", "windows.net", "google.com")
#: IPv4 networks that are not publicly routable (first address, prefix length).
UNROUTABLE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)

# Scoring.
WEIGHTS = {"business_impact": 0.40, "threat_confidence": 0.30, "response_effort": 0.20, "evidence_quality": 0.10}
THRESHOLDS = {"critical": 7.5, "high": 5.0, "medium": 2.5}
CHARS_PER_TOKEN = 3.5
READINESS = {"trail": 35, "multi_region": 10, "validation": 5, "data_events": 10, "guardduty": 20, "config": 8, "flow_logs": 7, "hub": 5}
