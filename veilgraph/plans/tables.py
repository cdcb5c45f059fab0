"""The rule and catalog tables that decide what becomes of a value, as plain values and as small DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..functions import paths

CATALOG_VERSION = 2

# Collection types and the node types they hold.
NODE_TYPES = {
    "adlocalgroups": "ADLocalGroup", "aiacas": "AIACA", "base": "Base", "certtemplates": "CertTemplate", "computers": "Computer", "containers": "Container",
    "domains": "Domain", "enterprisecas": "EnterpriseCA", "foreignsecurityprincipals": "Base", "gpos": "GPO", "groups": "Group", "issuancepolicies": "IssuancePolicy",
    "meta": "Meta", "ntauthstores": "NTAuthStore", "ous": "OU", "rootcas": "RootCA", "users": "User",
}
ALL_TYPES = ("ADLocalGroup", "AIACA", "Base", "CertTemplate", "Computer", "Container", "Domain", "EnterpriseCA", "GPO", "Group", "IssuancePolicy", "NTAuthStore", "OU", "RootCA", "User")
OBJECT_TYPES = ("ADLocalGroup", "ADLocalUser", "AIACA", "Base", "CertTemplate", "Computer", "Configuration", "Container", "Domain", "EnterpriseCA", "GPO", "Group", "IssuancePolicy", "NTAuthStore", "OU", "RootCA", "User")

# Names whose value is secret.
SECRETS = (
    "cleartextpassword", "cpassword", "dbcspwd", "initialauthincoming", "initialauthoutgoing", "lmhash", "lmpwdhistory", "ms-mcs-admpwd",
    "msds-managedpassword", "msfve-keypackage", "msfve-recoverypassword", "mslaps-encrypteddsrmpassword", "mslaps-encrypteddsrmpasswordhistory",
    "mslaps-encryptedpassword", "mslaps-encryptedpasswordhistory", "mslaps-password", "nthash", "ntpwdhistory", "password", "pwd", "sfupassword",
    "supplementalcredentials", "trustauthincoming", "trustauthoutgoing", "unicodepassword", "unicodepwd", "unixpassword", "userpassword",
)

# Allowed schema values.
RIGHTS = (
    "AddAllowedToAct", "AddKeyCredentialLink", "AddMember", "AddSelf", "AllExtendedRights", "AllowedToAct", "AllowedToDelegate", "CoerceToTGT",
    "DumpSMSAPassword", "Enroll", "EnrollOnBehalfOf", "ForceChangePassword", "GenericAll", "GenericRead", "GenericWrite", "GetChanges",
    "GetChangesAll", "GetChangesInFilteredSet", "GoldenCert", "ManageCA", "ManageCertificates", "ManageCertTemplates", "Owns", "ReadGMSAPassword",
    "ReadLAPSPassword", "ReadMSAPassword", "SQLAdmin", "SyncLAPSPassword", "WriteAccountRestrictions", "WriteAltSecurityIdentities", "WriteDacl",
    "WriteGPLink", "WriteOwner", "WritePKIEnrollmentFlag", "WritePKINameFlag", "WritePublicInformation", "WriteSPN",
)
CA_RIGHTS = ("Enroll", "ManageCA", "ManageCertificates", "Owns")
GPO_STATUSES = ("All Enabled", "All Settings Disabled", "Computer Configuration Disabled", "Computer Settings Disabled", "User Configuration Disabled", "User Settings Disabled")
TRUST_DIRECTIONS = ("Bidirectional", "Disabled", "Inbound", "Outbound")
TRUST_TYPES = ("CrossLink", "External", "Forest", "Kerberos", "ParentChild", "TreeRoot", "Unknown")
GROUP_TYPES = ("Global", "DomainLocal", "Universal")
ACCESS_TYPES = ("AccessAllowedCallback", "AccessDeniedCallback")
# Operating systems.
SYSTEMS = (
    "Windows 10 Education", "Windows 10 Enterprise", "Windows 10 Enterprise 2015 LTSB", "Windows 10 Enterprise 2016 LTSB",
    "Windows 10 Enterprise LTSC 2019", "Windows 10 Enterprise LTSC 2021", "Windows 10 Home", "Windows 10 IoT Enterprise", "Windows 10 Pro",
    "Windows 10 Pro Education", "Windows 10 Pro for Workstations", "Windows 11 Education", "Windows 11 Enterprise", "Windows 11 Home",
    "Windows 11 IoT Enterprise", "Windows 11 Pro", "Windows 11 Pro Education", "Windows 11 Pro for Workstations", "Windows 2000 Advanced Server",
    "Windows 2000 Professional", "Windows 2000 Server", "Windows 7 Enterprise", "Windows 7 Home Basic", "Windows 7 Home Premium",
    "Windows 7 Professional", "Windows 7 Ultimate", "Windows 8", "Windows 8 Enterprise", "Windows 8 Pro", "Windows 8.1", "Windows 8.1 Enterprise",
    "Windows 8.1 Pro", "Windows Vista Business", "Windows Vista Enterprise", "Windows Vista Home Basic", "Windows Vista Home Premium",
    "Windows Vista Ultimate", "Windows XP Professional", "Windows XP Professional x64 Edition", "Windows Server", "Windows Server 2003",
    "Windows Server 2003 Datacenter", "Windows Server 2003 Datacenter Evaluation", "Windows Server 2003 Enterprise", "Windows Server 2003 Essentials",
    "Windows Server 2003 Foundation", "Windows Server 2003 Standard", "Windows Server 2003 Standard Evaluation", "Windows Server 2003 Web",
    "Windows Server 2003 R2", "Windows Server 2003 R2 Datacenter", "Windows Server 2003 R2 Datacenter Evaluation",
    "Windows Server 2003 R2 Enterprise", "Windows Server 2003 R2 Essentials", "Windows Server 2003 R2 Foundation", "Windows Server 2003 R2 Standard",
    "Windows Server 2003 R2 Standard Evaluation", "Windows Server 2003 R2 Web", "Windows Server 2008", "Windows Server 2008 Datacenter",
    "Windows Server 2008 Datacenter Evaluation", "Windows Server 2008 Enterprise", "Windows Server 2008 Essentials", "Windows Server 2008 Foundation",
    "Windows Server 2008 Standard", "Windows Server 2008 Standard Evaluation", "Windows Server 2008 Web", "Windows Server 2008 R2",
    "Windows Server 2008 R2 Datacenter", "Windows Server 2008 R2 Datacenter Evaluation", "Windows Server 2008 R2 Enterprise",
    "Windows Server 2008 R2 Essentials", "Windows Server 2008 R2 Foundation", "Windows Server 2008 R2 Standard",
    "Windows Server 2008 R2 Standard Evaluation", "Windows Server 2008 R2 Web", "Windows Server 2012", "Windows Server 2012 Datacenter",
    "Windows Server 2012 Datacenter Evaluation", "Windows Server 2012 Enterprise", "Windows Server 2012 Essentials", "Windows Server 2012 Foundation",
    "Windows Server 2012 Standard", "Windows Server 2012 Standard Evaluation", "Windows Server 2012 Web", "Windows Server 2012 R2",
    "Windows Server 2012 R2 Datacenter", "Windows Server 2012 R2 Datacenter Evaluation", "Windows Server 2012 R2 Enterprise",
    "Windows Server 2012 R2 Essentials", "Windows Server 2012 R2 Foundation", "Windows Server 2012 R2 Standard",
    "Windows Server 2012 R2 Standard Evaluation", "Windows Server 2012 R2 Web", "Windows Server 2016", "Windows Server 2016 Datacenter",
    "Windows Server 2016 Datacenter Evaluation", "Windows Server 2016 Enterprise", "Windows Server 2016 Essentials", "Windows Server 2016 Foundation",
    "Windows Server 2016 Standard", "Windows Server 2016 Standard Evaluation", "Windows Server 2016 Web", "Windows Server 2019",
    "Windows Server 2019 Datacenter", "Windows Server 2019 Datacenter Evaluation", "Windows Server 2019 Enterprise", "Windows Server 2019 Essentials",
    "Windows Server 2019 Foundation", "Windows Server 2019 Standard", "Windows Server 2019 Standard Evaluation", "Windows Server 2019 Web",
    "Windows Server 2022", "Windows Server 2022 Datacenter", "Windows Server 2022 Datacenter Evaluation", "Windows Server 2022 Enterprise",
    "Windows Server 2022 Essentials", "Windows Server 2022 Foundation", "Windows Server 2022 Standard", "Windows Server 2022 Standard Evaluation",
    "Windows Server 2022 Web", "Windows Server 2025", "Windows Server 2025 Datacenter", "Windows Server 2025 Datacenter Evaluation",
    "Windows Server 2025 Enterprise", "Windows Server 2025 Essentials", "Windows Server 2025 Foundation", "Windows Server 2025 Standard",
    "Windows Server 2025 Standard Evaluation", "Windows Server 2025 Web",
)

# Paths by what they hold.
SID_PATHS = (
    "Aces[].PrincipalSID", "PrimaryGroupSID", "HasSIDHistory[]", "MemberOf[]", "Sessions.Results[].UserSID", "Sessions.Results[].ComputerSID",
    "PrivilegedSessions.Results[].UserSID", "PrivilegedSessions.Results[].ComputerSID", "RegistrySessions.Results[].UserSID",
    "RegistrySessions.Results[].ComputerSID", "NtlmSessions.Result.Sessions[].AccountSid", "DomainSID", "ForestRootIdentifier",
    "SPNTargets[].ComputerSID", "Properties.domainsid", "Properties.primarygroupsid", "Properties.objectsid", "Trusts[].TargetDomainSid",
    "CARegistryData.CASecurity.Data[].PrincipalSID", "Properties.CARegistryData.CASecurity.Data[].PrincipalSID",
)
IDENTIFIER_PATHS = (
    "Members[].ObjectIdentifier", "ChildObjects[].ObjectIdentifier", "AllowedToDelegate[].ObjectIdentifier", "AllowedToAct[].ObjectIdentifier",
    "HasSIDHistory[].ObjectIdentifier", "MemberOf[].ObjectIdentifier", "DumpSMSAPassword[].ObjectIdentifier", "LocalGroups[].ObjectIdentifier",
    "LocalGroups[].Results[].ObjectIdentifier", "HostingComputer", "CARegistryData.EnrollmentAgentRestrictions.Restrictions[].Agent.ObjectIdentifier",
    "CARegistryData.EnrollmentAgentRestrictions.Restrictions[].Targets[].ObjectIdentifier",
    "CARegistryData.EnrollmentAgentRestrictions.Restrictions[].Template.ObjectIdentifier", "ContainedBy.ObjectIdentifier",
    "EnabledCertTemplates[].ObjectIdentifier", "GPOChanges.AffectedComputers[].ObjectIdentifier", "GPOChanges.LocalAdmins[].ObjectIdentifier",
    "GPOChanges.RemoteDesktopUsers[].ObjectIdentifier", "GPOChanges.DcomUsers[].ObjectIdentifier", "GPOChanges.PSRemoteUsers[].ObjectIdentifier",
    "GroupLink.ObjectIdentifier", "LocalGroups[].LocalNames[].ObjectId", "UserRights[].Results[].ObjectIdentifier",
    "UserRights[].LocalNames[].ObjectId",
)
SYSTEM_PATH = "Properties.operatingsystem"
TEXT_PATHS = (
    "Properties.profilepath", "Properties.homedirectory", "Properties.scriptpath", "Properties.logonscript", "Properties.gpcpath",
    "Properties.gpcfilesyspath", "Properties.url", "Properties.uri", "Properties.certchain[]", "Properties.certchain", "Properties.operatingsystem",
    "Properties.operatingsystemversion", "Properties.description", "Properties.displayname", "Properties.info", "Properties.title",
    "NtlmSessions.Result.Sessions[].SourceIp", "NtlmSessions.Result.Sessions[].SourcePort", "NtlmSessions.Result.Sessions[].PackageName",
)
REASON_PATHS = ("Sessions.FailureReason", "PrivilegedSessions.FailureReason", "RegistrySessions.FailureReason", "LocalGroups[].FailureReason", "UserRights[].FailureReason")
OID_PATHS = (
    "Properties.oid", "Properties.ekus[]", "Properties.applicationpolicies[]", "Properties.certificateapplicationpolicy[]",
    "Properties.certificatepolicies[]", "Properties.certificatepolicy[]", "Properties.effectiveekus[]", "Properties.issuancepolicies[]",
)
GUID_PATHS = ("Properties.objectguid", "Properties.wkguid", "Links[].GUID", "Aces[].RightGuid")
TYPE_PATHS = (
    "Members[].ObjectType", "ChildObjects[].ObjectType", "AllowedToDelegate[].ObjectType", "AllowedToAct[].ObjectType", "HasSIDHistory[].ObjectType",
    "MemberOf[].ObjectType", "DumpSMSAPassword[].ObjectType", "LocalGroups[].Results[].ObjectType", "Aces[].PrincipalType",
    "CARegistryData.CASecurity.Data[].PrincipalType", "Properties.CARegistryData.CASecurity.Data[].PrincipalType",
    "CARegistryData.EnrollmentAgentRestrictions.Restrictions[].Agent.ObjectType",
    "CARegistryData.EnrollmentAgentRestrictions.Restrictions[].Targets[].ObjectType",
    "CARegistryData.EnrollmentAgentRestrictions.Restrictions[].Template.ObjectType", "ContainedBy.ObjectType", "EnabledCertTemplates[].ObjectType",
    "GPOChanges.AffectedComputers[].ObjectType", "GPOChanges.LocalAdmins[].ObjectType", "GPOChanges.RemoteDesktopUsers[].ObjectType",
    "GPOChanges.DcomUsers[].ObjectType", "GPOChanges.PSRemoteUsers[].ObjectType", "GroupLink.ObjectType", "UserRights[].Results[].ObjectType",
)
NUMBER_PATHS = (
    "meta.version", "meta.count", "meta.methods", "Properties.admincount", "Properties.authorizedsignatures", "Properties.basicconstraintpathlength",
    "Properties.flags", "Properties.lastlogon", "Properties.lastlogontimestamp", "Properties.lockoutobservationwindow", "Properties.lockoutthreshold",
    "Properties.machineaccountquota", "Properties.minpwdlength", "Properties.pwdhistorylength", "Properties.pwdlastset", "Properties.pwdproperties",
    "Properties.samaccounttype", "Properties.schemaversion", "Properties.useraccountcontrol", "Properties.whencreated", "Properties.whenchanged",
    "SPNTargets[].Port",
)
FLAG_PATHS = (
    "Properties.enabled", "Properties.hasspn", "Properties.highvalue", "Properties.isaclprotected", "Properties.isdc", "Properties.owned",
    "Properties.passwordnotreqd", "Properties.pwdneverexpires", "Properties.sensitive", "Properties.smartcardrequired", "Properties.trustedtoauth",
    "Properties.unconstraineddelegation", "Links[].IsEnforced", "Aces[].IsInherited", "Trusts[].SidFilteringEnabled", "Trusts[].IsTransitive",
    "Sessions.Collected", "PrivilegedSessions.Collected", "RegistrySessions.Collected", "LocalGroups[].Collected", "UserRights[].Collected",
    "IsDeleted", "IsACLProtected",
)
ALIAS_PATHS = ("Properties.gPCFileSysPath",)
# Single rules - id, path, operation, namespace, allowed values, node type.
SINGLE_RULES = (
    ("identifier.object", "ObjectIdentifier", "map_custom_identifier", None, None, "*"),
    ("common.properties-name", "Properties.name", "map_identity", "accounts", None, "*"),
    ("identity.domain", "Properties.domain", "map_identity", "domains", None, "*"),
    ("identity.target-domain-name", "Properties.targetdomainname", "map_identity", "domains", None, "*"),
    ("identity.sam-account-name", "Properties.samaccountname", "map_identity", "accounts", None, "*"),
    ("identity.user-principal-name", "Properties.userprincipalname", "map_identity", "accounts", None, "*"),
    ("identity.dns-host-name", "Properties.dnshostname", "map_identity", "hosts", None, "*"),
    ("identity.email", "Properties.email", "map_identity", "accounts", None, "*"),
    ("identity.mail", "Properties.mail", "map_identity", "accounts", None, "*"),
    ("dn.distinguished-name", "Properties.distinguishedname", "parse_dn", None, None, "*"),
    ("dn.manager", "Properties.manager", "parse_dn", None, None, "*"),
    ("spn.service-principal-name", "Properties.serviceprincipalnames[]", "parse_spn", None, None, "*"),
    ("template.internal-name", "Properties.templatename", "map_identity", "cert_templates", None, "*"),
    ("template.published-reference", "Properties.templates[]", "map_reference", "cert_templates", None, "*"),
    ("template.unresolved-reference", "Properties.unresolvedpublishedtemplates[]", "map_reference", "cert_templates", None, "*"),
    ("identity.ca-name", "Properties.caname", "map_identity", "accounts", None, "*"),
    ("identity.certificate-name", "Properties.certname", "map_identity", "accounts", None, "*"),
    ("schema.ace-right-name", "Aces[].RightName", "preserve_schema_value", None, RIGHTS, "*"),
    ("schema.ca-security-right-name", "CARegistryData.CASecurity.Data[].RightName", "preserve_schema_value", None, CA_RIGHTS, "*"),
    ("schema.properties-ca-security-right-name", "Properties.CARegistryData.CASecurity.Data[].RightName", "preserve_schema_value", None, CA_RIGHTS, "*"),
    ("identifier.ace-object-type", "Aces[].ObjectType", "map_custom_identifier", "guids", None, "*"),
    ("identifier.ace-object-type-guid", "Aces[].ObjectTypeGuid", "map_custom_identifier", "guids", None, "*"),
    ("identifier.ace-inherited-object-type", "Aces[].InheritedObjectType", "map_custom_identifier", "guids", None, "*"),
    ("identifier.ace-inherited-object-type-guid", "Aces[].InheritedObjectTypeGuid", "map_custom_identifier", "guids", None, "*"),
    ("schema.gpo-status", "Properties.gpostatus", "preserve_schema_value", None, GPO_STATUSES, "*"),
    ("schema.group-type", "Properties.grouptype", "preserve_schema_value", None, GROUP_TYPES, "*"),
    ("schema.group-scope", "Properties.groupscope", "preserve_schema_value", None, GROUP_TYPES, "*"),
    ("opaque.functional-level", "Properties.functionallevel", "replace_opaque", "opaque", None, "*"),
    ("schema.user-right-privilege", "UserRights[].Privilege", "preserve_schema_value", None, ("SeRemoteInteractiveLogonRight",), "*"),
    ("schema.enrollment-agent-access-type", "CARegistryData.EnrollmentAgentRestrictions.Restrictions[].AccessType", "preserve_schema_value", None, ACCESS_TYPES, "*"),
    ("schema.properties-enrollment-agent-access-type", "Properties.CARegistryData.EnrollmentAgentRestrictions.Restrictions[].AccessType", "preserve_schema_value", None, ACCESS_TYPES, "*"),
    ("schema.spn-target-service", "SPNTargets[].Service", "preserve_schema_value", None, ("SQLAdmin",), "*"),
    ("schema.foreign-security-principal-type", "Properties.type", "preserve_schema_value", None, ("foreignsecurityprincipal",), "Base"),
    ("schema.trust-direction", "Trusts[].TrustDirection", "preserve_schema_value", None, TRUST_DIRECTIONS, "*"),
    ("schema.trust-type", "Trusts[].TrustType", "preserve_schema_value", None, TRUST_TYPES, "*"),
    ("schema.meta-type", "meta.type", "preserve_schema_value", None, tuple(NODE_TYPES), "*"),
    ("identity.trust-target-domain-name", "Trusts[].TargetDomainName", "map_reference", "domains", None, "*"),
    ("identity.ntlm-account-name", "NtlmSessions.Result.Sessions[].AccountName", "map_identity", "accounts", None, "*"),
    ("identity.ntlm-account-domain", "NtlmSessions.Result.Sessions[].AccountDomain", "map_identity", "domains", None, "*"),
    ("identity.ntlm-source-host", "NtlmSessions.Result.Sessions[].SourceHost", "map_identity", "hosts", None, "*"),
    ("identity.local-group-local-name", "LocalGroups[].LocalNames[].PrincipalName", "map_identity", "accounts", None, "*"),
    ("identity.user-right-local-name", "UserRights[].LocalNames[].PrincipalName", "map_identity", "accounts", None, "*"),
    ("identity.local-groups-result-name", "LocalGroups[].Name", "parse_composite", None, None, "*"),
    ("identity.domain-name", "Properties.name", "map_identity", "domains", None, "Domain"),
    ("identity.computer-name", "Properties.name", "map_identity", "hosts", None, "Computer"),
    ("identity.template-name", "Properties.name", "map_identity", "cert_templates", None, "CertTemplate"),
    ("identity.local-group-composite", "Properties.name", "parse_composite", None, None, "ADLocalGroup"),
)
# Families of rules - id prefix, paths, operation, namespace, allowed values.
RULE_FAMILIES = (
    ("reference.sid", SID_PATHS, "map_reference", "sids", None),
    ("reference.identifier", IDENTIFIER_PATHS, "map_reference", "identifiers", None),
    ("opaque.path-url", TEXT_PATHS, "replace_opaque", "opaque", None),
    ("opaque.diagnostic", REASON_PATHS, "replace_opaque", "opaque", None),
    ("identifier.oid", OID_PATHS, "map_custom_identifier", "oids", None),
    ("identifier.guid", GUID_PATHS, "map_custom_identifier", "guids", None),
    ("schema.object-type", TYPE_PATHS, "preserve_schema_value", None, OBJECT_TYPES),
    ("schema.numeric", NUMBER_PATHS, "preserve_schema_value", None, None),
    ("schema.boolean", FLAG_PATHS, "preserve_schema_value", None, None),
)

# Built-in principals and objects.
SID_NAMES = {
    "S-1-0-0": "Nobody", "S-1-1-0": "Everyone", "S-1-2-0": "Local", "S-1-2-1": "Console Logon", "S-1-3-0": "Creator Owner", "S-1-3-1": "Creator Group",
    "S-1-3-2": "Creator Owner Server", "S-1-3-3": "Creator Group Server", "S-1-3-4": "Owner Rights", "S-1-5-1": "Dialup", "S-1-5-2": "Network", "S-1-5-3": "Batch",
    "S-1-5-4": "Interactive", "S-1-5-6": "Service", "S-1-5-7": "Anonymous", "S-1-5-8": "Proxy", "S-1-5-9": "Enterprise Domain Controllers", "S-1-5-10": "Principal Self",
    "S-1-5-11": "Authenticated Users", "S-1-5-12": "Restricted Code", "S-1-5-13": "Terminal Server User", "S-1-5-14": "Remote Interactive Logon", "S-1-5-15": "This Organization",
    "S-1-5-17": "IUSR", "S-1-5-18": "Local System", "S-1-5-19": "Local Service", "S-1-5-20": "Network Service", "S-1-5-32-544": "Administrators", "S-1-5-32-545": "Users",
    "S-1-5-32-546": "Guests", "S-1-5-32-547": "Power Users", "S-1-5-32-548": "Account Operators", "S-1-5-32-549": "Server Operators", "S-1-5-32-550": "Print Operators",
    "S-1-5-32-551": "Backup Operators", "S-1-5-32-552": "Replicator", "S-1-5-32-554": "Pre-Windows 2000 Compatible Access", "S-1-5-32-555": "Remote Desktop Users",
    "S-1-5-32-556": "Network Configuration Operators", "S-1-5-32-558": "Performance Monitor Users", "S-1-5-32-559": "Performance Log Users",
    "S-1-5-32-560": "Windows Authorization Access Group", "S-1-5-32-562": "Distributed COM Users", "S-1-5-32-573": "Event Log Readers",
    "S-1-5-32-579": "Access Control Assistance Operators", "S-1-5-32-581": "System Managed Accounts Group", "S-1-5-32-583": "Device Owners", "S-1-5-113": "Local account",
    "S-1-5-114": "Local account and member of Administrators group",
}
FEATURE_SIDS = (
    "S-1-5-32-553", "S-1-5-32-557", "S-1-5-32-561", "S-1-5-32-568", "S-1-5-32-569", "S-1-5-32-574", "S-1-5-32-575", "S-1-5-32-576", "S-1-5-32-577",
    "S-1-5-32-578", "S-1-5-32-580", "S-1-5-32-582", "S-1-5-32-585",
)
UNNAMED_SIDS = ("S-1-5-32-584",)
RIDS = {
    500: ("Administrator", "User"), 501: ("Guest", "User"), 502: ("krbtgt", "User"), 512: ("Domain Admins", "Group"), 513: ("Domain Users", "Group"), 514: ("Domain Guests", "Group"),
    515: ("Domain Computers", "Group"), 516: ("Domain Controllers", "Group"), 517: ("Cert Publishers", "Group"), 518: ("Schema Admins", "Group"), 519: ("Enterprise Admins", "Group"),
    520: ("Group Policy Creator Owners", "Group"), 521: ("Read-only Domain Controllers", "Group"), 522: ("Cloneable Domain Controllers", "Group"), 525: ("Protected Users", "Group"),
    526: ("Key Admins", "Group"), 527: ("Enterprise Key Admins", "Group"),
}
WKGUIDS = (
    ("computers", "Computers", "aa312825768811d1aded00c04fd8d5cd", "Container"),
    ("deleted-objects", "Deleted Objects", "18e2ea80684f11d2b9aa00c04f79f805", "Container"),
    ("domain-controllers", "Domain Controllers", "a361b2ffffd211d1aa4b00c04fd7d83a", "OU"),
    ("foreign-security-principals", "Foreign Security Principals", "22b70c67d56e4efb91e9300fca3dc1aa", "Container"),
    ("infrastructure", "Infrastructure", "2fbac1870ade11d297c400c04fd8d5cd", "Container"),
    ("lost-and-found", "LostAndFound", "ab8153b7768811d1aded00c04fd8d5cd", "Container"),
    ("microsoft-program-data", "Microsoft Program Data", "f4be92a4c777485e878e9421d53087db", "Container"),
    ("ntds-quotas", "NTDS Quotas", "6227f0af1fc2410d8e3bb10615bb5b0f", "Container"),
    ("program-data", "Program Data", "09460c08ae1e4a4ea0f64aee7daa1e5a", "Container"),
    ("system", "System", "ab1d30f3768811d1aded00c04fd8d5cd", "Container"),
    ("users", "Users", "a9d1ca15768811d1aded00c04fd8d5cd", "Container"),
    ("managed-service-accounts", "Managed Service Accounts", "1eb93889e40c45df9f0c64d23bbb6237", "Container"),
)
TEMPLATES = (
    "Administrator", "Authenticated Session", "Basic EFS", "CA Exchange", "CEP Encryption", "Code Signing", "Computer", "Cross-Certification Authority", "Directory E-mail Replication",
    "Domain Controller", "Domain Controller Authentication", "EFS Recovery Agent", "Enrollment Agent", "Enrollment Agent (Computer)", "Exchange Enrollment Agent (Offline request)",
    "Exchange Signature Only", "Exchange User", "IPSEC", "IPSEC (Offline request)", "Kerberos Authentication", "Key Recovery Agent", "OCSP Response Signing", "RAS and IAS Server",
    "Root Certification Authority", "Router (Offline request)", "Smartcard Logon", "Smartcard User", "Subordinate Certification Authority", "Trust List Signing", "User",
    "User Signature Only", "Web Server", "Workstation Authentication",
)
OIDS = (
    "2.5.29.37.0", "1.3.6.1.5.5.7.3.1", "1.3.6.1.5.5.7.3.2", "1.3.6.1.5.5.7.3.3", "1.3.6.1.5.5.7.3.4", "1.3.6.1.5.5.7.3.8", "1.3.6.1.5.5.7.3.9", "1.3.6.1.5.2.3.5",
    "1.3.6.1.4.1.311.20.2.1", "1.3.6.1.4.1.311.20.2.2", "1.3.6.1.4.1.311.10.3.4", "1.3.6.1.4.1.311.10.3.4.1",
)
RIGHT_GUIDS = (
    "00299570-246d-11d0-a768-00aa006e0529", "ab721a53-1e2f-11d0-9819-00aa0040529b", "1131f6aa-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2",
    "89e95b76-444d-4c62-991a-0facbeda640c", "0e10c968-78fb-11d2-90d4-00c04f79dc55", "a05b8cc2-17bc-4802-a710-e7c15ab866a2",
)
POLICIES = (("default-domain-policy", "31b2f340-016d-11d2-945f-00c04fb984f9"), ("default-domain-controllers-policy", "6ac1786c-016f-11d2-945f-00c04fb984f9"))
NULL_GUID = "00000000-0000-0000-0000-000000000000"
PRINCIPAL_PATHS = ("ObjectIdentifier", "Aces[].PrincipalSID", "Members[].ObjectIdentifier", "Properties.objectsid")
NAME_PATHS = ("Properties.name", "Properties.samaccountname")
TEMPLATE_PATHS = ("Properties.name", "Properties.templatename", "Properties.templates[]", "Properties.unresolvedpublishedtemplates[]")
ACE_PATHS = ("Aces[].ObjectType", "Aces[].ObjectTypeGuid", "Aces[].InheritedObjectType", "Aces[].InheritedObjectTypeGuid", "Aces[].RightGuid")
CORE, FEATURE, THIRD = "core_global_default", "microsoft_feature_default", "third_party_default"


@dataclass(frozen=True)
class Config:
    """What a run keeps."""

    preserve_core: bool = True
    preserve_feature: bool = False
    preserve_third_party: bool = False
    redact_undeclared_numbers: bool = True
    preserve_os_strings: bool = True

    def keeps(self) -> list[str]:
        return [c for c, on in ((CORE, self.preserve_core), (FEATURE, self.preserve_feature), (THIRD, self.preserve_third_party)) if on]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    path: str
    operation: str
    namespace: str | None = None
    allowed: tuple[str, ...] | None = None
    node_types: tuple[str, ...] = ("*",)


@dataclass(frozen=True)
class Entry:
    """A built-in identifier: where it may stay (path -> exact value, case-folded) and in which node types."""

    rule_id: str
    kind: str
    value: str
    node_types: tuple[str, ...]
    privacy: str
    keep: tuple[tuple[str, str], ...]


def rules(config: Config = Config()) -> list[Rule]:
    out = [Rule(i, p, op, ns, tuple(ok) if ok else None, (t,)) for i, p, op, ns, ok, t in SINGLE_RULES]
    for prefix, own, op, ns, ok in RULE_FAMILIES:
        out += [Rule(f"{prefix}.{paths.canonical(p)}", p, op, ns, ok) for p in own if not (config.preserve_os_strings and p == SYSTEM_PATH)]
    if config.preserve_os_strings:
        out.append(Rule("schema.operating-system", SYSTEM_PATH, "preserve_schema_value", None, SYSTEMS))
    return out


def check_rules(own: list[Rule]) -> None:
    seen = set()
    for r in own:
        if not r.node_types:
            raise ValueError(f"rule {r.rule_id} has no node types")
        for t in r.node_types:
            if (key := (t, paths.canonical(r.path))) in seen:
                raise ValueError(f"two rules for {key}")
            seen.add(key)


def normal(kind: str, value: str) -> str:
    return value.casefold() if kind in ("NAME", "TEMPLATE") else value.lower() if kind in ("GUID", "WKGUID") else value.upper() if kind == "SID" else value


@lru_cache
def catalog() -> tuple[Entry, ...]:
    def own(rule_id, kind, value, types, at, privacy=CORE):
        return Entry(rule_id, kind, normal(kind, value), tuple(types), privacy, tuple((p, v.casefold()) for p, v in at))

    same = lambda where, v: [(p, v) for p in where]
    out = [own("guid.null", "GUID", NULL_GUID, ALL_TYPES, same(("ObjectIdentifier", *ACE_PATHS), NULL_GUID))]
    for slug, g in POLICIES:
        out.append(own(f"gpo.{slug}", "GUID", g, ["GPO"], [("ObjectIdentifier", g)]))
        out.append(own(f"gpo-link.{slug}", "GUID", g, ["Container", "Domain", "OU"], [("Links[].GUID", g)]))
    for s in sorted((*SID_NAMES, *FEATURE_SIDS, *UNNAMED_SIDS)):
        name = SID_NAMES.get(s)
        out.append(own("sid." + s[4:].replace("-", "."), "SID", s, ALL_TYPES, same(PRINCIPAL_PATHS, s) + (same(NAME_PATHS, name) if name else []), FEATURE if s in FEATURE_SIDS else CORE))
    for rid, (name, t) in RIDS.items():
        out.append(own("rid." + name.lower().replace(" ", "-"), "RID", str(rid), [t], same(PRINCIPAL_PATHS, str(rid)) + same(NAME_PATHS, name)))
    for slug, name, g, t in WKGUIDS:
        out.append(own(f"wkguid.{slug}", "WKGUID", g, [t], [("Properties.wkguid", g), *same(NAME_PATHS, name)]))
    out += [own(f"template.builtin-{k:02}", "TEMPLATE", n, ["CertTemplate"], same(TEMPLATE_PATHS, n)) for k, n in enumerate(TEMPLATES, 1)]
    out += [own(f"oid.standard-{k:02}", "OID", o, ["CertTemplate", "IssuancePolicy"], same(OID_PATHS, o)) for k, o in enumerate(OIDS, 1)]
    out += [own(f"access-right.predefined-{k:02}", "GUID", g, ALL_TYPES, same(ACE_PATHS, g)) for k, g in enumerate(RIGHT_GUIDS, 1)]
    return tuple(out)


def core_names() -> set[str]:
    """The case-folded names of built-in principals, objects and templates."""
    return {v for e in catalog() if e.privacy == CORE and e.kind in ("SID", "RID", "WKGUID", "TEMPLATE") for p, v in e.keep if p in NAME_PATHS or e.kind == "TEMPLATE"}


def rules_frame(spark: SparkSession, own: list[Rule]) -> DataFrame:
    """A row for each rule and node type, in lookup form. Some hundreds of rows."""
    rows = [(t, paths.canonical(r.path), r.rule_id, r.operation, r.namespace, list(r.allowed) if r.allowed is not None else None) for r in own for t in r.node_types]
    return spark.createDataFrame(rows, "rule_type string, rule_path string, rule_id string, operation string, namespace string, allowed array<string>")


def permits_frame(spark: SparkSession, config: Config) -> DataFrame:
    """A row for each catalog entry, node type and path at which the run's profile keeps it. Some thousands of rows."""
    rows = [(e.rule_id, e.kind, e.value, t, e.privacy, paths.canonical(p), v) for e in catalog() if e.privacy in config.keeps() for t in e.node_types for p, v in e.keep]
    return spark.createDataFrame(rows, "entry_id string, kind string, value string, entry_type string, entry_privacy string, entry_path string, exact string")


def catalog_frame(spark: SparkSession) -> DataFrame:
    """A row for each catalog entry and node type."""
    rows = [(e.rule_id, e.kind, e.value, t, e.privacy, "ObjectIdentifier" in dict(e.keep)) for e in catalog() for t in e.node_types]
    return spark.createDataFrame(rows, "entry_id string, kind string, value string, entry_type string, entry_privacy string, at_identifier boolean")


def known_prefixes(own: list[Rule]) -> dict[str, set[str]]:
    """node type -> exact key paths that are declared."""
    out: dict[str, set[str]] = {}
    for r in own:
        for t in r.node_types:
            out.setdefault(t, set()).update(paths.prefixes(r.path))
    for p in ALIAS_PATHS:
        out.setdefault("*", set()).update(paths.prefixes(p))
    return out
