"""Document schemas of a project folder (fixed, versioned)."""

GROUP = "struct<id:string,name:string,color:string,render:string,opacity:double,size:double,labels:boolean,labelSize:double,hidden:boolean,locked:boolean>"
SOURCE = "struct<kind:string,fileId:string,version:string,md5Checksum:string>"
IMAGE = f"struct<id:string,name:string,imageGroupId:string,width:bigint,height:bigint,mimeType:string,byteSize:bigint,fingerprint:string,source:{SOURCE},addedAt:string,deletedAt:string>"
STORAGE = "struct<kind:string,folderId:string,folderName:string,account:string>"
PROJECT = f"schemaVersion int, id string, name string, createdAt string, updatedAt string, imageGroups array<struct<id:string,name:string>>, images array<{IMAGE}>, annotationGroups array<{GROUP}>, storage {STORAGE}, revision bigint, _corrupt_record string"
DETECTOR = "struct<name:string,version:string,runId:string,params:map<string,string>,confidence:double>"
ANNOTATION = f"struct<id:string,x:double,y:double,groupId:string,origin:string,createdAt:string,updatedAt:string,reviewStatus:string,reviewedAt:string,lastEditSource:string,manuallyAdjusted:boolean,detector:{DETECTOR},geometry:struct<kind:string,r:double,quality:double,source:string>>"
DOCUMENT = f"schemaVersion int, projectId string, imageId string, imageFingerprint string, width bigint, height bigint, groups array<{GROUP}>, annotations array<{ANNOTATION}>, updatedAt string, _corrupt_record string"
